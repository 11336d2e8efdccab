"""Grouped statistics over the event log and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""
SELECT user_id, CAST(round_even(value / 10, 0) AS BIGINT) AS bin, count(*) AS n,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2 HAVING count(*) >= 3
""")
def a11_binned_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of each user's values by bin of width 10; bins of fewer than three values are left out."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL AND NOT isnan(value)")
    return (
        rows.groupBy("user_id", F.rint(F.col("value") / 10).cast("long").alias("bin"))
        .agg(F.count("*").alias("n"), q.alias("q"))
        .filter("n >= 3")
        .select("user_id", "bin", "n", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q25", "q50", "q75"))))
    )
