"""Vector queries over embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.plans.catalog import catalog
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

LABELS = ("contradiction", "entailment", "neutral")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty vectors, unequal lengths and zero norms."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 2k and 2k + 1 side by side; one grouped pass instead of a join."""
    row = F.struct("vec_id", "label", "e")
    both = vectors(spark, sf_dir).groupBy(F.expr("vec_id div 2").alias("pair")).agg(F.min_by(row, "vec_id").alias("a"), F.max_by(row, "vec_id").alias("b"))
    return both.filter("a.vec_id < b.vec_id")


def nearest_query(spark: SparkSession, sf_dir: str) -> Column:
    """The vector of the least id as a literal: one row."""
    return F.lit(vectors(spark, sf_dir).orderBy("vec_id").select("e").first()["e"])


PAIRS = "SELECT a.vec_id // 2 AS pair, a.label AS la, b.label AS lb, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0"
COSINE = "list_inner_product({0}, {1}) / sqrt(list_inner_product({0}, {0}) * list_inner_product({1}, {1}))"


@query("""SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_inner_product(e[1:32], e[1:32])), 6) AS first, round(e[32] / sqrt(list_inner_product(e[1:32], e[1:32])), 6) AS last
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def p13_matryoshka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of each vector, and the ends of its first 32 components at length 1."""
    e, head = F.col("e"), F.slice("e", 1, 32)
    size = F.greatest(F.sqrt(dot(head, head)), F.lit(1e-12))
    return vectors(spark, sf_dir).select("vec_id", F.round(F.sqrt(dot(e, e)), 6).alias("norm"), F.round(e[0] / size, 6).alias("first"), F.round(e[31] / size, 6).alias("last"))


@query("""SELECT pos, round(avg(x), 7) AS mean FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""")
def a31_corpus_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector, a row per component."""
    return vectors(spark, sf_dir).select(F.posexplode("e").alias("pos", "x")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("x"), 7).alias("mean"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v ORDER BY vec_id LIMIT 1),
coarse AS (SELECT vec_id, e, q FROM v, q ORDER BY round({COSINE.format("e[1:32]", "q[1:32]")}, 9) DESC, vec_id LIMIT 60)
SELECT vec_id, round({COSINE.format("e", "q")}, 6) AS score FROM coarse ORDER BY round({COSINE.format("e", "q")}, 9) DESC, vec_id LIMIT 10""")
def j10_two_stage_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors: the best sixty by 32 components, scored anew by all."""
    q = nearest_query(spark, sf_dir)
    coarse = vectors(spark, sf_dir).withColumn("c", F.round(cosine(F.slice("e", 1, 32), F.slice(q, 1, 32)), 9)).orderBy(F.desc("c"), "vec_id").limit(60)
    fine = coarse.withColumn("f", F.round(cosine(F.col("e"), q), 9)).orderBy(F.desc("f"), "vec_id").limit(10)
    return fine.select("vec_id", F.round("f", 6).alias("score"))


@query(f"""SELECT la = lb AS same, count(*) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS low, round(max(c), 6) AS high FROM (SELECT la, lb, {COSINE.format("x", "y")} AS c FROM ({PAIRS})) GROUP BY 1""")
def j11_pair_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of given pairs, summed up for pairs of one label and of two."""
    scored = pairs(spark, sf_dir).select((F.col("a.label") == F.col("b.label")).alias("same"), cosine(F.col("a.e"), F.col("b.e")).alias("c"))
    return scored.groupBy("same").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("low"), F.round(F.max("c"), 6).alias("high"))


@query(f"""SELECT round(min(c), 6) AS low, round(max(c), 6) AS high, round(avg(c), 6) AS mean, round(list_sort(list(c))[count(*) // 2 + 1], 6) AS middle FROM (SELECT {COSINE.format("x", "y")} AS c FROM ({PAIRS}))""")
def a30_null_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, mean and upper median of the cosines of unrelated pairs."""
    scored = pairs(spark, sf_dir).select(cosine(F.col("a.e"), F.col("b.e")).alias("c"))
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c DESC)")
    return scored.agg(F.round(F.min("c"), 6).alias("low"), F.round(F.max("c"), 6).alias("high"), F.round(F.avg("c"), 6).alias("mean"), F.round(middle, 6).alias("middle"))


@query("""SELECT vec_id, round(list_max(list_transform(e, lambda x: abs(lo + round_even((x - lo) / s, 0) * s - x))), 8) AS error FROM (
SELECT vec_id, e, list_min(e) AS lo, CASE WHEN list_max(e) > list_min(e) THEN (list_max(e) - list_min(e)) / 255 ELSE 1.0 END AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
def p15_sq8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest error of each vector after 8-bit quantisation and back."""
    rows = vectors(spark, sf_dir).withColumn("lo", F.array_min("e")).withColumn("hi", F.array_max("e"))
    rows = rows.withColumn("s", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(1.0))
    back = lambda x: F.abs(F.col("lo") + F.rint((x - F.col("lo")) / F.col("s")) * F.col("s") - x)
    return rows.select("vec_id", F.round(F.array_max(F.transform("e", back)), 8).alias("error"))


def judged(e: Column) -> Column:
    """Label and confidence of the first three components as logits, by a stable softmax; ties go to the first."""
    logits = F.transform(F.slice(e, 1, 3), lambda x: x * 20)
    top = F.array_max(logits)
    mass = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    name = F.element_at(F.array(*(F.lit(x) for x in LABELS)), F.array_position(logits, top).cast("int"))
    return F.struct(name.alias("label"), (1 / mass).alias("conf"))


JUDGED = "['contradiction', 'entailment', 'neutral'][list_position({0}[1:3], list_max({0}[1:3]))] AS l{1}, 1 / list_sum(list_transform({0}[1:3], lambda v: exp(20 * v - 20 * list_max({0}[1:3])))) AS c{1}"


@query(f"""SELECT vec_id, l1 AS label, round(c1, 6) AS conf, CASE WHEN l1 = 'entailment' AND c1 >= 0.6 THEN 'PASS' WHEN l1 = 'contradiction' THEN 'STOP' ELSE 'NEED_INFO' END AS gate
FROM (SELECT vec_id, {JUDGED.format("e", 1)} FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
def f19_softmax_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax label, confidence and gate of each vector's first three components."""
    rows = vectors(spark, sf_dir).select("vec_id", judged(F.col("e")).alias("j")).select("vec_id", "j.label", "j.conf")
    gate = F.when((F.col("label") == "entailment") & (F.col("conf") >= 0.6), "PASS").when(F.col("label") == "contradiction", "STOP").otherwise("NEED_INFO")
    return rows.select("vec_id", "label", F.round("conf", 6).alias("conf"), gate.alias("gate"))


@query(f"""SELECT pair, CASE WHEN l1 = 'entailment' AND l2 = 'entailment' AND least(c1, c2) >= 0.6 THEN 'PASS' WHEN 'contradiction' IN (l1, l2) THEN 'STOP' ELSE 'NEED_INFO' END AS verdict, round(least(c1, c2), 6) AS conf,
CASE WHEN l1 = 'entailment' AND l2 = 'entailment' THEN 'closed' WHEN l1 = 'entailment' THEN 'dropped' WHEN l2 = 'entailment' THEN 'added' WHEN 'contradiction' IN (l1, l2) THEN 'inverted' ELSE 'unrelated' END AS mode
FROM (SELECT pair, {JUDGED.format("x", 1)}, {JUDGED.format("y", 2)} FROM ({PAIRS}))""")
def f20_mutual_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and round-trip mode (f21) of judgements in both directions."""
    rows = pairs(spark, sf_dir).select("pair", judged(F.col("a.e")).alias("f"), judged(F.col("b.e")).alias("r"))
    fwd, rev, conf = F.col("f.label"), F.col("r.label"), F.least("f.conf", "r.conf")
    closed, against = (fwd == "entailment") & (rev == "entailment"), (fwd == "contradiction") | (rev == "contradiction")
    mode = F.when(closed, "closed").when(fwd == "entailment", "dropped").when(rev == "entailment", "added").when(against, "inverted").otherwise("unrelated")
    verdict = F.when(closed & (conf >= 0.6), "PASS").when(against, "STOP").otherwise("NEED_INFO")
    return rows.select("pair", verdict.alias("verdict"), F.round(conf, 6).alias("conf"), mode.alias("mode"))


@query("""WITH e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
SELECT a AS i, a AS j, count(*)::DOUBLE AS v FROM s GROUP BY 1 UNION ALL SELECT a, b, -count(*)::DOUBLE FROM s GROUP BY 1, 2""")
def g10_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplacian of the nation-region graph as (i, j, v)."""
    e = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("i"), F.concat(F.lit("r"), "n_regionkey").alias("j"))
    s = e.union(e.select("j", "i"))
    off = s.groupBy("i", "j").agg((-F.count("*")).cast("double").alias("v"))
    return s.groupBy("i").agg(F.count("*").cast("double").alias("v")).select("i", F.col("i").alias("j"), "v").union(off)
