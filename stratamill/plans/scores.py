"""Scored rows: base and candidate errors of lineitem by supplier, repeat and fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.plans.catalog import catalog
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

SSE = """(SELECT l_suppkey AS entity, l_linenumber % 2 AS repeat, l_suppkey % 5 AS fold, count(*) AS n, sum((l_quantity - 25) ** 2) AS base_sse,
sum((l_quantity - 25 - 40 * (l_discount - 0.05)) ** 2) AS cand_sse FROM lineitem GROUP BY 1, 2, 3)"""
PER = f"(SELECT entity, sqrt(sum(base_sse) / sum(n)) AS base, sqrt(sum(cand_sse) / sum(n)) AS cand, sum(base_sse) - sum(cand_sse) AS benefit, sum(n)::BIGINT AS n, sum(base_sse) AS bs, sum(cand_sse) AS cs FROM {SSE} GROUP BY 1)"


def sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sufficient statistics by entity, repeat and fold."""
    base = F.col("l_quantity") - 25
    cand = base - 40 * (F.col("l_discount") - 0.05)
    keys = [F.col("l_suppkey").alias("entity"), (F.col("l_linenumber") % 2).alias("repeat"), (F.col("l_suppkey") % 5).alias("fold")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"), F.sum(base * base).alias("base_sse"), F.sum(cand * cand).alias("cand_sse"))


def per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats are summed for each entity first."""
    pooled = sse(spark, sf_dir).groupBy("entity").agg(F.sum("n").alias("n"), F.sum("base_sse").alias("bs"), F.sum("cand_sse").alias("cs"))
    return pooled.select("entity", "n", "bs", "cs", F.sqrt(F.col("bs") / F.col("n")).alias("base"), F.sqrt(F.col("cs") / F.col("n")).alias("cand"), (F.col("bs") - F.col("cs")).alias("benefit"))


@query(f"SELECT entity, repeat, fold, n, round(base_sse, 4) AS base_sse, round(cand_sse, 4) AS cand_sse FROM {SSE}")
def a4_sse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and squared errors."""
    return sse(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("base_sse", "cand_sse")})


@query(f"""SELECT count(*) AS entities, round(quantile_cont(base - cand, 0.5), 6) AS median_gain, round(avg((base > cand)::INT), 6) AS win_rate, round(quantile_cont(base, 0.9), 6) AS base_p90,
round(quantile_cont(cand, 0.9) - quantile_cont(base, 0.9), 6) AS p90_worsening FROM {PER}""")
def a5_pooled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of paired gains, win rate, and the change of the 90th percentile (a10)."""
    per = per_entity(spark, sf_dir)
    p90 = {c: F.percentile(c, 0.9) for c in ("base", "cand")}
    out = {"median_gain": F.percentile(F.col("base") - F.col("cand"), 0.5), "win_rate": F.avg((F.col("base") > F.col("cand")).cast("int")), "base_p90": p90["base"], "p90_worsening": p90["cand"] - p90["base"]}
    return per.agg(F.count("*").alias("entities"), *(F.round(c, 6).alias(k) for k, c in out.items()))


@query(f"SELECT repeat, round(sqrt(sum(base_sse) / sum(n)) - sqrt(sum(cand_sse) / sum(n)), 6) AS gain FROM {SSE} GROUP BY 1")
def a6_pooled_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of the pooled RMSE in each repeat."""
    rmse = lambda c: F.sqrt(F.sum(c) / F.sum("n"))
    return sse(spark, sf_dir).groupBy("repeat").agg(F.round(rmse("base_sse") - rmse("cand_sse"), 6).alias("gain"))


@query(f"SELECT entity, sum(n)::BIGINT AS n, round(sum(base_sse) - sum(cand_sse), 4) AS benefit FROM {SSE} GROUP BY 1 HAVING count(DISTINCT repeat) = 2")
def a7_paired_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are in both repeats."""
    found = sse(spark, sf_dir).groupBy("entity").agg(F.sum("n").alias("n"), F.round(F.sum("base_sse") - F.sum("cand_sse"), 4).alias("benefit"), F.countDistinct("repeat").alias("_r"))
    return found.filter("_r = 2").drop("_r")


@query(f"SELECT round(quantile_cont(base, 0.25), 6) AS q25, round(quantile_cont(base, 0.9), 6) AS q90 FROM (SELECT base, unnest(range(entity % 4)) FROM {PER})")
def a9_replicated_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of values that count several times, without copies of them."""
    rows = per_entity(spark, sf_dir).withColumn("m", F.col("entity") % 4).filter("m > 0")
    return rows.agg(*(F.round(F.percentile("base", p / 100, F.col("m")), 6).alias(f"q{p}") for p in (25, 90)))


@query("""SELECT l_returnflag, CASE WHEN count(*) < 4 THEN 1.0 ELSE round(greatest(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 1.0), 6) END AS scale FROM lineitem GROUP BY 1""")
def a12_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interquartile range, 1 at least."""
    q = F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.75)))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.when(F.count("*") < 4, 1.0).otherwise(F.round(F.greatest(q[1] - q[0], F.lit(1.0)), 6)).alias("scale"))


@query("""SELECT user_id, round(greatest(1.4826 * quantile_cont(abs(value - m), 0.5), 0.001), 6) AS scale FROM (SELECT user_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1""")
def a13_mad_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median absolute deviation of each series, as a normal scale."""
    rows = table(spark, sf_dir, "events").select("user_id", "value")
    middle = rows.groupBy("user_id").agg(F.percentile("value", 0.5).alias("m"))
    spread = rows.join(middle, "user_id").groupBy("user_id").agg(F.percentile(F.abs(F.col("value") - F.col("m")), 0.5).alias("d"))
    return spread.select("user_id", F.round(F.greatest(1.4826 * F.col("d"), F.lit(0.001)), 6).alias("scale"))


@query("""SELECT l_suppkey, min(l_extendedprice) AS median FROM (SELECT l_suppkey, l_extendedprice, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total
FROM (SELECT l_suppkey, l_extendedprice, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)) WHERE run >= 0.5 * total GROUP BY 1""")
def a13_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least price at which half of a supplier's quantity is reached."""
    w = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_extendedprice").agg(F.sum("l_quantity").alias("w"))
    by = Window.partitionBy("l_suppkey")
    run = F.sum("w").over(by.orderBy("l_extendedprice").rowsBetween(Window.unboundedPreceding, 0))
    return w.withColumns({"run": run, "total": F.sum("w").over(by)}).filter("run >= 0.5 * total").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("median"))


X1, X2, Y = "(l_discount - 0.05)", "(l_tax - 0.04)", "(l_quantity - 25)"
SUMS = f"sum({X1} * {X1}) AS s11, sum({X1} * {X2}) AS s12, sum({X2} * {X2}) AS s22, sum({X1} * {Y}) AS t1, sum({X2} * {Y}) AS t2, sum({Y} * {Y}) AS yy"


@query(f"""SELECT fold, round(((s22 + 1) * t1 - s12 * t2) / ((s11 + 1) * (s22 + 1) - s12 * s12), 5) AS b1, round(((s11 + 1) * t2 - s12 * t1) / ((s11 + 1) * (s22 + 1) - s12 * s12), 5) AS b2,
round(1 - (yy - 2 * 0.5 * t1 + 0.25 * s11) / yy, 8) AS r2, round(greatest(0, least(1.5, t1 / s11)), 5) AS shrink FROM (SELECT l_suppkey % 5 AS fold, {SUMS} FROM lineitem GROUP BY 1)""")
def a17_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge coefficients of two features in closed form, R2 of a fixed predictor (a20) and the clipped shrink (a18)."""
    sums = [F.expr(x.rpartition(" AS ")[0]).alias(x.rpartition(" AS ")[2]) for x in SUMS.split(", ")]
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fold")).agg(*sums)
    det = "((s11 + 1) * (s22 + 1) - s12 * s12)"
    out = {"b1": f"round(((s22 + 1) * t1 - s12 * t2) / {det}, 5)", "b2": f"round(((s11 + 1) * t2 - s12 * t1) / {det}, 5)"}
    out |= {"r2": "round(1 - (yy - t1 + 0.25D * s11) / yy, 8)", "shrink": "round(greatest(0D, least(1.5D, t1 / s11)), 5)"}
    return s.select("fold", *(F.expr(x).alias(k) for k, x in out.items()))


@query(f"""SELECT fold, min(s) AS best FROM (SELECT fold, s, rank() OVER (PARTITION BY fold ORDER BY round(yy - 2 * s * t1 + s * s * s11, 4)) AS r FROM
(SELECT l_suppkey % 5 AS fold, {SUMS} FROM lineitem GROUP BY 1), (SELECT range / 40 AS s FROM range(61))) WHERE r = 1 GROUP BY 1""")
def a19_shrink_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 61 factors by squared error, the least one of equals."""
    e = lambda x: F.sum(F.expr(x))
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fold")).agg(e(f"{X1} * {X1}").alias("s11"), e(f"{X1} * {Y}").alias("t1"), e(f"{Y} * {Y}").alias("yy"))
    cost = lambda i: F.struct(F.round(F.col("yy") - 2 * (i / 40) * F.col("t1") + (i / 40) * (i / 40) * F.col("s11"), 4).alias("c"), (i / 40).alias("s"))
    return s.select("fold", F.array_min(F.transform(F.sequence(F.lit(0), F.lit(60)), cost))["s"].alias("best"))


FOLD = f"(SELECT fold, sum(n) AS n, sum(base_sse) AS b, sum(cand_sse) AS c FROM {SSE} GROUP BY 1)"


@query(f"""WITH f AS {FOLD}, d AS (SELECT sqrt((p.b + q.b + r.b + s.b + t.b) / (p.n + q.n + r.n + s.n + t.n)) - sqrt((p.c + q.c + r.c + s.c + t.c) / (p.n + q.n + r.n + s.n + t.n)) AS gain FROM f p, f q, f r, f s, f t)
SELECT count(*) AS draws, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high, round(avg((gain > 0)::INT), 6) AS positive FROM d""")
def a23_exhaustive_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the gain over all 3125 ordered draws of five folds; only the five folds' sums are broadcast."""
    folds = sse(spark, sf_dir).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.sum("n").alias("n"), F.sum("base_sse").alias("b"), F.sum("cand_sse").alias("c"))
    drawn = spark.range(5**5).select("id", F.explode(F.array(*(F.expr(f"id div {5**i} % 5") for i in range(5)))).alias("fold"))
    gain = F.sqrt(F.sum("b") / F.sum("n")) - F.sqrt(F.sum("c") / F.sum("n"))
    draws = drawn.join(F.broadcast(folds), "fold").groupBy("id").agg(gain.alias("gain"))
    out = {"low": F.percentile("gain", 0.025), "high": F.percentile("gain", 0.975), "positive": F.avg((F.col("gain") > 0).cast("int"))}
    return draws.agg(F.count("*").alias("draws"), *(F.round(c, 6).alias(k) for k, c in out.items()))


@query(f"""WITH p AS {PER}, top AS (SELECT entity FROM p WHERE benefit > 0 ORDER BY round(benefit, 4) DESC, entity LIMIT 10)
SELECT count(*) AS entities, round(sqrt(sum(bs) / sum(n)) - sqrt(sum(cs) / sum(n)), 6) AS gain FROM p WHERE entity NOT IN (SELECT entity FROM top)""")
def t3_top_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain without the ten entities that contribute most."""
    per = per_entity(spark, sf_dir)
    top = per.filter("benefit > 0").orderBy(F.desc(F.round("benefit", 4)), "entity").limit(10).select("entity")
    rmse = lambda c: F.sqrt(F.sum(c) / F.sum("n"))
    return per.join(F.broadcast(top), "entity", "left_anti").agg(F.count("*").alias("entities"), F.round(rmse("bs") - rmse("cs"), 6).alias("gain"))


@query("""SELECT count(*) FILTER (WHERE folds > 1) AS split_entities, count(*) FILTER (WHERE n <> d) AS repeated_keys FROM (
SELECT l_suppkey, count(DISTINCT l_suppkey % 5) AS folds, count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS d FROM lineitem GROUP BY 1)""")
def a26_leak_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in several folds and entities with repeated keys."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min(F.col("l_suppkey") % 5).alias("fold"))
    per = rows.groupBy("l_suppkey").agg(F.max("n").alias("n"), F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    return per.agg(F.count_if(F.col("lo") != F.col("hi")).alias("split_entities"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


@query("""SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 6))::BIGINT % 100 < 35 AS held_out FROM customer""")
def p3_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out by the leading hex digits of a digest."""
    digits = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6), 16, 10).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", (digits % 100 < 35).alias("held_out"))
