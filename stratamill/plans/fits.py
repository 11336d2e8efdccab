"""Small fits, resampling and parsed labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.functions import payload
from stratamill.plans.catalog import catalog
from stratamill.plans.scores import SSE, sse
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

#: Draws of the cluster bootstrap, and the seed of their stream.
DRAWS, SEED = 4000, 20260810

RAW = """(SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '{"label": "Entailment ", "confidence": 0.5}' WHEN 1 THEN 'this is NEUTRAL' WHEN 2 THEN 'neutral or entailment'
WHEN 3 THEN '```json' || chr(10) || '{"label": "contradiction"}' || chr(10) || '```' ELSE '{"label": "entailment|neutral"}' END || CASE WHEN role = 'user' THEN ' ' ELSE '' END AS raw FROM conversations)"""


@query(f"""SELECT conv_id, turn, CASE WHEN json_valid(obj) THEN CASE WHEN lab IN ('entailment', 'neutral', 'contradiction') THEN lab ELSE 'INVALID' END
WHEN len(hits) = 1 THEN hits[1] ELSE 'INVALID' END AS label FROM (
SELECT *, CASE WHEN json_valid(obj) THEN lower(trim(obj ->> '$.label')) END AS lab, list_filter(['entailment', 'neutral', 'contradiction'], lambda l: contains(lower(raw), l)) AS hits FROM (
SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}') AS obj FROM {RAW}))""")
def f18_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels out of what a judge wrote: its JSON, or the one label it names."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", r"""concat(CASE turn % 5 WHEN 0 THEN '{"label": "Entailment ", "confidence": 0.5}' WHEN 1 THEN 'this is NEUTRAL' WHEN 2 THEN 'neutral or entailment'
        WHEN 3 THEN '```json\n{"label": "contradiction"}\n```' ELSE '{"label": "entailment|neutral"}' END, CASE WHEN role = 'user' THEN ' ' ELSE '' END) AS raw""")
    return rows.select("conv_id", "turn", payload.parse_label(F.col("raw")).alias("label"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(raw), '^```(json|JSON|js|javascript)?\\s*', ''), '\\s*```\\s*$', '')) AS text FROM {RAW}")
def f13_code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without the fences around them."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", r"""concat(CASE turn % 5 WHEN 0 THEN '{"label": "Entailment ", "confidence": 0.5}' WHEN 1 THEN 'this is NEUTRAL' WHEN 2 THEN 'neutral or entailment'
        WHEN 3 THEN '```json\n{"label": "contradiction"}\n```' ELSE '{"label": "entailment|neutral"}' END, CASE WHEN role = 'user' THEN ' ' ELSE '' END) AS raw""")
    return rows.select("conv_id", "turn", payload.strip_fences(F.col("raw")).alias("text"))


@query("""SELECT doc_id, round(0.65 * CASE WHEN hn - ln > 1e-12 THEN (n - ln) / (hn - ln) ELSE 0.5 END + 0.35 * CASE WHEN hp - lp > 1e-12 THEN (p - lp) / (hp - lp) ELSE 0.5 END, 6) AS score FROM (
SELECT doc_id, n, p, min(n) OVER w AS ln, max(n) OVER w AS hn, min(p) OVER w AS lp, max(p) OVER w AS hp FROM (SELECT doc_id, source, (doc_id * 37 % 101) / 100.0::DOUBLE AS n, (n_chars % 31) / 30.0::DOUBLE AS p FROM documents)
WINDOW w AS (PARTITION BY source))""")
def f10_neural_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's score and the earlier one, each scaled to its range among the candidates of a query; flat ones count as a half."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") * 37 % 101 / 100.0).alias("n"), (F.col("n_chars") % 31 / 30.0).alias("p"))
    ends = rows.groupBy(F.col("source").alias("_s")).agg(*(f(c).alias(f"{name}_{c}") for c in "np" for name, f in (("low", F.min), ("high", F.max))))
    scaled = lambda c: F.when(F.col(f"high_{c}") - F.col(f"low_{c}") > 1e-12, (F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}"))).otherwise(0.5)
    both = rows.join(ends, F.col("source").eqNullSafe(F.col("_s")))
    return both.select("doc_id", F.round(0.65 * scaled("n") + 0.35 * scaled("p"), 6).alias("score"))


THETA = """WITH s AS (SELECT l_suppkey AS entity, sum(r * r) AS rr, sum(f * f) AS ff, sum(b * b) AS bb, sum(f * b) AS fb, sum(f * r) AS fr, sum(b * r) AS br
FROM (SELECT l_suppkey, l_quantity - 25 AS r, 400 * (l_discount - 0.05) AS f, 400 * (l_tax - 0.04) AS b FROM lineitem) GROUP BY 1),
k AS (SELECT *, (fr * bb - br * fb) / nullif(ff * bb - fb * fb, 0) AS ua, (br * ff - fr * fb) / nullif(ff * bb - fb * fb, 0) AS ub FROM s),
c AS (SELECT *, unnest([{'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}, {'a': 1.0, 'b': 0.0}, {'a': 1.0, 'b': 1.0}, CASE WHEN 0 <= ub AND ub <= ua AND ua <= 1 THEN {'a': ua, 'b': ub} END,
CASE WHEN ff > 0 THEN {'a': least(greatest(fr / ff, 0), 1), 'b': 0.0} END, CASE WHEN bb > 0 THEN {'a': 1.0, 'b': least(greatest((br - fb) / bb, 0), 1)} END,
CASE WHEN ff + 2 * fb + bb > 0 THEN {'a': least(greatest((fr + br) / (ff + 2 * fb + bb), 0), 1), 'b': least(greatest((fr + br) / (ff + 2 * fb + bb), 0), 1)} END]) AS t FROM k),
o AS (SELECT entity, t.a AS a, t.b AS b, rr - 2 * t.a * fr - 2 * t.b * br + t.a * t.a * ff + 2 * t.a * t.b * fb + t.b * t.b * bb AS objective FROM c WHERE t IS NOT NULL)
SELECT entity, round(a, 5) AS theta_field, round(b, 5) AS theta_bias, round(objective, 3) AS objective FROM o QUALIFY row_number() OVER (PARTITION BY entity ORDER BY objective, a, b) = 1"""


@query(THETA)
def g14_theta_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of two weights with 0 <= bias <= field <= 1, for each entity: six sums, and the best of seven candidates."""
    r, f, b = F.col("l_quantity") - 25, 400 * (F.col("l_discount") - 0.05), 400 * (F.col("l_tax") - 0.04)
    sums = {"rr": r * r, "ff": f * f, "bb": b * b, "fb": f * b, "fr": f * r, "br": b * r}
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    c = {k: F.col(k) for k in sums}
    zero, one = F.lit(0.0), F.lit(1.0)
    det = F.nullif(c["ff"] * c["bb"] - c["fb"] * c["fb"], zero)
    ua, ub = (c["fr"] * c["bb"] - c["br"] * c["fb"]) / det, (c["br"] * c["ff"] - c["fr"] * c["fb"]) / det
    clip = lambda x: F.least(F.greatest(x, zero), one)
    point = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    both = c["ff"] + 2 * c["fb"] + c["bb"]
    edge = clip((c["fr"] + c["br"]) / F.nullif(both, zero))
    tried = [point(zero, zero), point(one, zero), point(one, one), F.when((ub >= 0) & (ub <= ua) & (ua <= 1), point(ua, ub))]
    tried += [F.when(c["ff"] > 0, point(clip(c["fr"] / F.nullif("ff", zero)), zero)), F.when(c["bb"] > 0, point(one, clip((c["br"] - c["fb"]) / F.nullif("bb", zero)))), F.when(both > 0, point(edge, edge))]

    def scored(t):
        a, b = t["a"], t["b"]
        return F.struct((c["rr"] - 2 * a * c["fr"] - 2 * b * c["br"] + a * a * c["ff"] + 2 * a * b * c["fb"] + b * b * c["bb"]).alias("o"), a.alias("a"), b.alias("b"))

    best = F.array_min(F.transform(F.array_compact(F.array(*tried)), scored))
    return found.select("entity", best.alias("t")).select("entity", F.round("t.a", 5).alias("theta_field"), F.round("t.b", 5).alias("theta_bias"), F.round("t.o", 3).alias("objective"))


def multiplicities(spark: SparkSession, groups: int, draws: int, seed: int) -> DataFrame:
    """draw, g, m: how often group g (from 0) is in each draw, from one NumPy stream; groups must be few."""
    picked = np.random.default_rng(seed).integers(0, groups, (draws, groups))
    counts = np.stack([np.bincount(p, minlength=groups) for p in picked])
    draw, g = np.nonzero(counts)
    return spark.createDataFrame(pd.DataFrame({"draw": draw, "g": g, "m": counts[draw, g]}))


def cluster_bootstrap(stats: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """draw, gain for statistics (cluster, repeat, n, base_sse, cand_sse): the mean over repeats of the gain in pooled RMSE.

    A draw takes the same clusters in all repeats. Clusters are numbered in order; only the statistics, a row for
    each cluster and repeat, meet the draws.
    """
    spark = stats.sparkSession
    summed = stats.groupBy("cluster", "repeat").agg(*(F.sum(c).alias(c) for c in ("n", "base_sse", "cand_sse")))
    numbered = summed.withColumn("g", F.dense_rank().over(Window.orderBy("cluster")) - 1)
    drawn = multiplicities(spark, summed.select("cluster").distinct().count(), draws, seed)
    total = lambda c: F.sum(F.col("m") * F.col(c))
    each = numbered.join(drawn, "g").groupBy("draw", "repeat").agg((F.sqrt(total("base_sse") / total("n")) - F.sqrt(total("cand_sse") / total("n"))).alias("gain"))
    return each.groupBy("draw").agg(F.avg("gain").alias("gain"))


@query()
def a22_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the pooled gain under draws of folds that both repeats share."""
    drawn = cluster_bootstrap(sse(spark, sf_dir).withColumnRenamed("fold", "cluster"))
    at = F.percentile("gain", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    found = drawn.agg(F.count("*").alias("draws"), at.alias("q"), F.avg((F.col("gain") > 0).cast("double")).alias("p_positive"))
    return found.select("draws", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("low", "median", "high"))), F.round("p_positive", 6).alias("p_positive"))


@query(f"""SELECT fold, round(min(gain), 6) AS low, round(max(gain), 6) AS high, min(gain) < 0 AND max(gain) > 0 AS flips FROM (
SELECT fold, repeat, sqrt(sum(base_sse) / sum(n)) - sqrt(sum(cand_sse) / sum(n)) AS gain FROM {SSE} GROUP BY 1, 2) GROUP BY 1""")
def a41_stability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of each fold's gain over the repeats, and whether its sign flips."""
    rmse = lambda c: F.sqrt(F.sum(c) / F.sum("n"))
    gains = sse(spark, sf_dir).groupBy("fold", "repeat").agg((rmse("base_sse") - rmse("cand_sse")).alias("gain"))
    low, high = F.min("gain"), F.max("gain")
    return gains.groupBy("fold").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), ((low < 0) & (high > 0)).alias("flips"))


@query("""SELECT label, round(CASE WHEN a < 0 THEN a + 180 ELSE a END, 5) AS azimuth FROM (
SELECT label, degrees(atan2(2 * covar_pop(embedding[1]::DOUBLE, embedding[2]::DOUBLE), var_pop(embedding[1]::DOUBLE) - var_pop(embedding[2]::DOUBLE))) / 2 AS a FROM embeddings GROUP BY 1)""")
def g22_section_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the principal axis of each label's points, from north in degrees, in closed form."""
    north, east = (F.col("embedding")[i].cast("double") for i in (0, 1))
    angle = F.degrees(F.atan2(2 * F.covar_pop(north, east), F.var_pop(north) - F.var_pop(east))) / 2
    found = table(spark, sf_dir, "embeddings").groupBy("label").agg(angle.alias("a"))
    return found.select("label", F.round(F.when(F.col("a") < 0, F.col("a") + 180).otherwise(F.col("a")), 5).alias("azimuth"))


@query("""SELECT doc_id, forward = 'entailment' AND back = 'entailment' AS closed, CASE WHEN forward = 'entailment' AND back = 'entailment' THEN 'closed' WHEN forward = 'entailment' THEN 'dropped'
WHEN back = 'entailment' THEN 'added' WHEN 'contradiction' IN (forward, back) THEN 'inverted' ELSE 'unrelated' END AS mode FROM (
SELECT doc_id, (['entailment', 'neutral', 'contradiction'])[doc_id % 3 + 1] AS forward, (['entailment', 'neutral', 'contradiction'])[doc_id // 3 % 3 + 1] AS back FROM documents)""")
def f21_round_trip_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a round trip did to a text, from what its two ends entail."""
    label = lambda i: F.element_at(F.array(*map(F.lit, payload.LABELS)), (i % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", label(F.col("doc_id")).alias("forward"), label(F.floor(F.col("doc_id") / 3)).alias("back"))
    return rows.select("doc_id", *payload.round_trip(F.col("forward"), F.col("back")))


#: Groups that may be dealt to folds on the driver.
GROUPS = 100_000


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group, size, fold: the largest group first, each into the fold that is smallest so far; ties by group and by fold.

    Raises ValueError beyond GROUPS groups, as sizes are dealt on the driver.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("size")).orderBy(F.desc("size"), F.asc_nulls_last(group)).limit(GROUPS + 1).collect()
    if len(sizes) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    held, out = [0] * folds, []
    for row in sizes:
        fold = held.index(min(held))
        held[fold] += row["size"]
        out.append((row[group], row["size"], fold))
    return rows.sparkSession.createDataFrame(out, f"{group} {rows.schema[group].dataType.simpleString()}, size long, fold int")


@query()
def g3_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations dealt to five folds of nearly equal numbers of customers."""
    return group_folds(table(spark, sf_dir, "customer"), "c_nationkey")
