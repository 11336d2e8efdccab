"""Ordered series over the event log (user = series, ts = depth) and text and vector scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
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


def by_time():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def so_far():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("""SELECT user_id, count(*) AS n, round(sqrt(avg((value - 50) * (value - 50))), 6) AS rmse FROM events GROUP BY 1""")
def a1_entity_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of each series against a constant."""
    e = F.col("value") - 50
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("""SELECT round(quantile_cont(r, 0.5), 6) AS median_rmse, round(avg(r), 6) AS mean_rmse, round(quantile_cont(r, 0.9), 6) AS p90_rmse, round(sqrt(sum(s) / sum(n)), 6) AS pooled_rmse
FROM (SELECT user_id, count(*) AS n, sum((value - 50) * (value - 50)) AS s, sqrt(avg((value - 50) * (value - 50))) AS r FROM events GROUP BY 1)""")
def a3_metric_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, mean and 90th percentile of the series' RMSE, and the pooled RMSE."""
    e = F.col("value") - 50
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(e * e).alias("s"), F.sqrt(F.avg(e * e)).alias("r"))
    out = {"median_rmse": F.percentile("r", 0.5), "mean_rmse": F.avg("r"), "p90_rmse": F.percentile("r", 0.9), "pooled_rmse": F.sqrt(F.sum("s") / F.sum("n"))}
    return per.agg(*(F.round(c, 6).alias(k) for k, c in out.items()))


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.1), 6) AS q10, round(quantile_cont(l_quantity, 0.5), 6) AS q50, round(quantile_cont(l_quantity, 0.9), 6) AS q90 FROM lineitem GROUP BY 1""")
def a8_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact linear quantiles."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.round(F.percentile("l_quantity", p / 100), 6).alias(f"q{p}") for p in (10, 50, 90)))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1""")
def a15_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares line and correlation."""
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.corr(y, x), 6).alias("r"))


@query("""SELECT quality, count(*) FILTER (WHERE toxic = 0) AS pred_0, count(*) FILTER (WHERE toxic = 1) AS pred_1 FROM labels GROUP BY 1""")
def a27_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix of two labels."""
    return table(spark, sf_dir, "labels").groupBy("quality").agg(*(F.count_if(F.col("toxic") == k).alias(f"pred_{k}") for k in (0, 1)))


@query("""SELECT l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1""")
def a43_weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-weighted average."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted"))


@query("""SELECT event_id, round(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS held FROM events""")
def w2_hold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known value of each series."""
    known = F.when(F.col("event_type") == "view", F.col("value"))
    return events(spark, sf_dir).select("event_id", F.round(F.last(known, ignorenulls=True).over(so_far()), 6).alias("held"))


@query("""SELECT event_id, min(CASE WHEN value < 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS supported FROM events""")
def w8_persistent_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support that once lost is never regained."""
    return events(spark, sf_dir).select("event_id", F.min(F.when(F.col("value") < 90, 1).otherwise(0)).over(so_far()).alias("supported"))


@query("""SELECT event_id, round(coalesce(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 4) AS integral FROM (
SELECT *, (value + lag(value) OVER w) / 2 * (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def w9_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative trapezoid integral over hours."""
    rows = events(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    step = (F.col("value") + F.lag("value").over(by_time())) / 2 * (F.col("t") - F.lag("t").over(by_time())) / 3.6e9
    return rows.withColumn("step", step).select("event_id", F.round(F.coalesce(F.sum("step").over(so_far()), F.lit(0.0)), 4).alias("integral"))


@query("""SELECT user_id, count(*) FILTER (WHERE s <> p) AS reversals FROM (SELECT user_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (
SELECT *, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events) WHERE s <> 0) GROUP BY 1""")
def w12_sign_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of direction of each series, level steps left out."""
    steps = events(spark, sf_dir).withColumn("s", F.signum(F.col("value") - F.lag("value").over(by_time()))).filter("s <> 0")
    return steps.withColumn("p", F.lag("s").over(by_time())).groupBy("user_id").agg(F.count_if(F.col("s") != F.col("p")).alias("reversals"))


@query("""SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j3_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is in a set."""
    ids = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def o5_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each id."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS n_tokens FROM documents""")
def f1_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct retrieval tokens of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]{3,})"), F.lit(1)))).alias("n_tokens"))


@query("""SELECT vec_id, round(list_min(embedding)::DOUBLE, 6) AS lo, round((list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 255, 8) AS scale FROM embeddings""")
def p15_sq8_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and step of each vector's 8-bit quantisation."""
    lo, hi = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(lo, 6).alias("lo"), F.round((hi - lo) / 255, 8).alias("scale"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN z <= 1 THEN 0.5 * z * z ELSE least(z - 0.5, 3) END AS cost FROM (SELECT *, abs(l_quantity - 25) / 10 AS z FROM lineitem)""")
def p6_huber_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped robust cost."""
    z = F.abs(F.col("l_quantity") - 25) / 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(z <= 1, 0.5 * z * z).otherwise(F.least(z - 0.5, F.lit(3.0))).alias("cost"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def t1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest scores, ties by id."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
