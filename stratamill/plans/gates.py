"""Bootstraps with weights from digests, gates over them, and projections of one text onto many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.functions import text as X
from stratamill.plans.catalog import catalog
from stratamill.plans.scores import PER, per_entity
from stratamill.plans.texts import BOTH_EMPTY, PROJECTED
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

DRAWS = 200
#: Where the distribution function of a Poisson count with mean 1 passes 0, 1, 2, 3 and 4.
STEPS = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)


def weight(key: Column) -> Column:
    """How often a draw has a row: a Poisson count from the digest of row and draw, so a rerun draws the same anywhere."""
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum((F.when(u >= x, 1).otherwise(0) for x in STEPS[1:]), F.when(u >= STEPS[0], 1).otherwise(0))


def weight_sql(key: str) -> str:
    u = f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    return "(" + " + ".join(f"({u} >= {x})::INT" for x in STEPS) + ")"


def drawn(rows: DataFrame, key: str) -> DataFrame:
    """rows with draw and w, a row for each draw that has it."""
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    return rows.withColumn("w", weight(F.concat_ws("|", key, "draw"))).filter("w > 0")


BOOT = f"(SELECT draw, sum(w * (base - cand)) / sum(w) AS gain FROM (SELECT *, {weight_sql('entity || chr(124) || draw')} AS w FROM {PER}, (SELECT unnest(range({DRAWS})) AS draw)) WHERE w > 0 GROUP BY 1)"


@query(f"SELECT count(*) AS draws, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high, round(avg((gain > 0)::INT), 6) AS positive FROM {BOOT}")
def a21_entity_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean gain over draws of entities."""
    gains = drawn(per_entity(spark, sf_dir).select("entity", (F.col("base") - F.col("cand")).alias("g")), "entity")
    draws = gains.groupBy("draw").agg((F.sum(F.col("w") * F.col("g")) / F.sum("w")).alias("gain"))
    return draws.agg(F.count("*").alias("draws"), F.round(F.percentile("gain", 0.025), 6).alias("low"), F.round(F.percentile("gain", 0.975), 6).alias("high"), F.round(F.avg((F.col("gain") > 0).cast("int")), 6).alias("positive"))


ARMS = {"b": "l_quantity - 25", "d": "l_quantity - 25 - 40 * (l_discount - 0.05)", "t": "l_quantity - 25 - 30 * (l_tax - 0.04)", "j": "l_quantity - 25 - 40 * (l_discount - 0.05) - 30 * (l_tax - 0.04)"}
ARM_SUMS = ", ".join(f"sum(({e}) * ({e})) AS {k}" for k, e in ARMS.items())
CLUSTERS = f"""(SELECT draw, repeat, sqrt(sum(w * b) / sum(w * n)) AS b, sqrt(sum(w * d) / sum(w * n)) AS d, sqrt(sum(w * t) / sum(w * n)) AS t, sqrt(sum(w * j) / sum(w * n)) AS j
FROM (SELECT *, {weight_sql('cluster || chr(124) || draw')} AS w FROM (SELECT l_suppkey % 25 AS cluster, l_linenumber % 2 AS repeat, count(*) AS n, {ARM_SUMS} FROM lineitem GROUP BY 1, 2), (SELECT unnest(range({DRAWS})) AS draw)) WHERE w > 0 GROUP BY 1, 2)"""


def cluster_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw, b, d, t, j: root mean squares of four arms, averaged over repeats that share a draw's clusters."""
    keys = [(F.col("l_suppkey") % 25).alias("cluster"), (F.col("l_linenumber") % 2).alias("repeat")]
    sums = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.expr(f"({e}) * ({e})")).alias(k) for k, e in ARMS.items()))
    rmse = [F.sqrt(F.sum(F.col("w") * F.col(k)) / F.sum(F.col("w") * F.col("n"))).alias(k) for k in ARMS]
    per = drawn(sums, "cluster").groupBy("draw", "repeat").agg(*rmse)
    return per.groupBy("draw").agg(*(F.avg(k).alias(k) for k in ARMS))


@query(f"""SELECT round(avg(b - j), 6) AS mean, round(quantile_cont(b - j, 0.025), 6) AS low, round(quantile_cont(b - j, 0.975), 6) AS high, round(avg((b > j)::INT), 6) AS positive
FROM (SELECT draw, avg(b) AS b, avg(j) AS j FROM {CLUSTERS} GROUP BY 1)""")
def a24_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the joint arm's gain over draws of clusters, the same for both repeats."""
    gain = F.col("b") - F.col("j")
    found = {"mean": F.avg(gain), "low": F.percentile(gain, 0.025), "high": F.percentile(gain, 0.975), "positive": F.avg((gain > 0).cast("int"))}
    return cluster_draws(spark, sf_dir).agg(*(F.round(x, 6).alias(k) for k, x in found.items()))


@query(f"""SELECT round(quantile_cont(lead, 0.025), 6) AS low, round(quantile_cont(lead, 0.975), 6) AS high, round(avg((lead > 0)::INT), 6) AS positive
FROM (SELECT draw, least(avg(d), avg(t)) - avg(j) AS lead FROM {CLUSTERS} GROUP BY 1)""")
def a25_joint_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the joint arm beats the better of its components, draw by draw."""
    lead = F.least("d", "t") - F.col("j")
    found = {"low": F.percentile(lead, 0.025), "high": F.percentile(lead, 0.975), "positive": F.avg((lead > 0).cast("int"))}
    return cluster_draws(spark, sf_dir).agg(*(F.round(x, 6).alias(k) for k, x in found.items()))


@query(f"""SELECT gain > 0 AS pooled_gain, median > 0 AS median_gain, wins >= 0.5 AS win_rate, worse <= 0.05 AS tail, low > 0 AS interval, gain > 0 AND median > 0 AND wins >= 0.5 AND worse <= 0.05 AND low > 0 AS supported FROM (
SELECT sqrt(sum(bs) / sum(n)) - sqrt(sum(cs) / sum(n)) AS gain, quantile_cont(base - cand, 0.5) AS median, avg((base > cand)::INT) AS wins, quantile_cont(cand, 0.9) - quantile_cont(base, 0.9) AS worse FROM {PER}), (SELECT round(quantile_cont(gain, 0.025), 6) AS low FROM {BOOT})""")
def a42_support_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that a candidate must pass, and whether it passes all."""
    gain = F.col("base") - F.col("cand")
    sums = per_entity(spark, sf_dir).agg(
        (F.sqrt(F.sum("bs") / F.sum("n")) - F.sqrt(F.sum("cs") / F.sum("n"))).alias("gain"), F.percentile(gain, 0.5).alias("median"), F.avg((gain > 0).cast("int")).alias("wins"), (F.percentile("cand", 0.9) - F.percentile("base", 0.9)).alias("worse")
    )
    low = a21_entity_bootstrap(spark, sf_dir).first()["low"]
    gates = {"pooled_gain": F.col("gain") > 0, "median_gain": F.col("median") > 0, "win_rate": F.col("wins") >= 0.5, "tail": F.col("worse") <= 0.05, "interval": F.lit(bool(low is not None and low > 0))}
    every = F.lit(True)
    for g in gates.values():
        every = every & g
    return sums.select(*(g.alias(k) for k, g in gates.items()), every.alias("supported"))


@query(f"""WITH h AS (SELECT list_distinct({PROJECTED}) AS h FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)), d AS (SELECT doc_id, list_distinct({PROJECTED}) AS d FROM documents)
SELECT doc_id, round({BOTH_EMPTY.format("h", "d")}, 6) AS similarity, len(list_intersect(h, d)) AS shared, len(h) - len(list_intersect(h, d)) AS only_human FROM d, h""")
def j12_bilateral_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text's features against those of every document: shared, missing, similarity (o3's intersections and differences)."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    h = X.words_of(first.select(F.array_distinct(X.projection_tokens(F.col("text"))).alias("t")).first()["t"])
    found = X.let(F.array_distinct(X.projection_tokens(F.col("text"))), lambda d: F.struct(F.round(X.jaccard(h, d, 1.0), 6).alias("similarity"), F.size(F.array_intersect(h, d)).cast("long").alias("shared"), F.size(F.array_except(h, d)).cast("long").alias("only_human")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.*")


HEADERS = r"(?m)^[ \t]*([0-9]+\.(?:[0-9]+\.)?[ \t]+[A-Za-z][^\n]{8,100})"


@query(rf"""SELECT conv_id, turn, len(t) AS n_headers, md5(array_to_string(t, '|')) AS headers_md5 FROM (SELECT conv_id, turn, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all('1. Scope of the work' || chr(10) || '2.1. ' || coalesce(text, ''), '{HEADERS}', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: length(x) >= 12))[1:16] AS t FROM conversations)""")
def f27_section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered headers of each turn under two given ones, once each, sixteen at most."""
    text = F.concat(F.lit("1. Scope of the work\n2.1. "), F.coalesce("text", F.lit("")))
    found = F.transform(F.regexp_extract_all(text, F.lit(HEADERS), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    t = F.slice(F.array_sort(F.filter(F.array_distinct(found), lambda x: F.length(x) >= 12)), 1, 16)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n_headers"), F.md5(F.array_join("t", "|")).alias("headers_md5"))
