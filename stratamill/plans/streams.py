"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.plans.catalog import catalog
from stratamill.session import table
from stratamill.streaming.events import closed_windows, drain

query, QUERIES, ORACLE_SQL = catalog()


@query("""SELECT epoch_us(start) AS start_us, event_type, n, total FROM (
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def st_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and totals by hour of the windows that the watermark has closed."""
    # as a pattern the path may be one file as well as a folder of files
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    found = drain(spark, closed_windows(rows))
    return found.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))
