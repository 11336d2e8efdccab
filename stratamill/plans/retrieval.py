"""Ranking documents for a query text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.functions import text as X
from stratamill.operators.spatial import cut
from stratamill.plans.catalog import catalog
from stratamill.plans.vectors import COSINE, cosine, nearest_query, vectors
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

K1, B = 1.5, 0.75


BM25_SQL = f"""WITH q AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}'))) AS term FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{3,}}')) AS t, list_distinct(regexp_extract_all(lower(substr(coalesce(text, ''), 1, 800)), '[a-z0-9_]{{3,}}')) AS head FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), df AS (SELECT term, count(*) AS c FROM d, q WHERE list_contains(t, term) GROUP BY 1),
raw AS (SELECT doc_id, sum(ln(1 + (n - c + 0.5) / (c + 0.5)) * {K1 + 1} / (1 + {K1} * (1 - {B} + {B} * greatest(len(t), 1) / avgdl))) AS s FROM d, st, df WHERE list_contains(t, term) GROUP BY 1),
lex AS (SELECT doc_id, count(*) / (SELECT count(*) FROM q) AS lex FROM d, q WHERE list_contains(head, term) GROUP BY 1)"""


@query(f"""{BM25_SQL}
SELECT doc_id, round(b, 5) AS bm25, round(coalesce(lex, 0), 5) AS lex, round(0.25 * coalesce(lex, 0) + 0.25 * b, 5) AS score
FROM (SELECT doc_id, s / (SELECT max(s) FROM raw) AS b FROM raw) LEFT JOIN lex USING (doc_id) ORDER BY round(0.25 * coalesce(lex, 0) + 0.25 * b, 9) DESC, doc_id LIMIT 20""")
def f8_bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best documents for the first benchmark text by BM25 over token sets and word overlap (f9 has the cosine).

    Each text is tokenised once, and what is kept of it are the query's terms it has; the query's terms and, for them,
    the numbers of documents are as many as one text has words.
    """
    scored = bm25(spark, sf_dir)
    best = scored.withColumn("f", 0.25 * F.col("lex") + 0.25 * F.col("b")).orderBy(F.desc(F.round("f", 9)), "doc_id").limit(20)
    return best.select("doc_id", F.round("b", 5).alias("bm25"), F.round("lex", 5).alias("lex"), F.round("f", 5).alias("score"))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, b (BM25 over its greatest value), lex (share of the query's words in the first 800 characters) of documents with a term."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    terms = first.select(X.retrieval_tokens(F.col("text")).alias("t")).first()["t"]
    asked = X.words_of(terms)
    found = X.let(X.retrieval_tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("n"), F.array_intersect(t, asked).alias("hit")))
    head = F.size(F.array_intersect(X.retrieval_tokens(F.substring("text", 1, 800)), asked)) / len(terms)
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", found.alias("d"), head.alias("lex")).select("doc_id", "d.n", "d.hit", "lex"))
    whole = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    df = docs.select(F.explode("hit").alias("term")).groupBy("term").agg(F.count("*").alias("c"))
    idf = F.broadcast(df.select("term", F.log(1 + (whole["docs"] - F.col("c") + 0.5) / (F.col("c") + 0.5)).alias("idf")))
    length = 1 + K1 * (1 - B + B * F.greatest(F.col("n"), F.lit(1)) / (whole["mean"] or 1.0))
    scored = docs.select("doc_id", "n", "lex", F.explode("hit").alias("term")).join(idf, "term").groupBy("doc_id", "lex").agg(F.sum(F.col("idf") * (K1 + 1) / length).alias("s"))
    scored = cut(scored.filter("s > 0"))
    top = scored.agg(F.max("s")).first()[0] or 1.0
    return scored.select("doc_id", "lex", (F.col("s") / top).alias("b"))


FILLERS = "task is ongoing|monitoring|smooth execution|further analysis"


@query(f"""{BM25_SQL},
h AS (SELECT r.doc_id, coalesce(lex, 0) AS lex, s / (SELECT max(s) FROM raw) AS b, {COSINE.format("v.e", "z.e")} AS c, regexp_matches(lower(substr(text, 1, 120)), '{FILLERS}') AS fill
FROM raw r LEFT JOIN lex USING (doc_id) JOIN documents USING (doc_id) JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v ON v.vec_id = r.doc_id, (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1) z),
f AS (SELECT doc_id, (0.7 * c * (0.2 + 0.8 * greatest(lex, 0.5 * b)) + 0.075 * c + 0.25 * lex + 0.25 * b) * CASE WHEN fill AND lex < 0.15 AND b < 0.2 THEN 0.5 ELSE 1 END AS score FROM h)
SELECT doc_id, round(score, 5) AS score FROM f ORDER BY round(score, 9) DESC, doc_id LIMIT 20""")
def f9_hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best documents by cosine, gated by word overlap and BM25, with both of these; the cosine is that of the
    vector of the document's id and the first vector. Filler that the words don't support counts half."""
    q = nearest_query(spark, sf_dir)
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), cosine(F.col("e"), q).alias("c"))
    fill = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.substring("text", 1, 120)).rlike(FILLERS).alias("fill"))
    rows = bm25(spark, sf_dir).join(v, "doc_id").join(fill, "doc_id")
    gated = F.col("c") * (0.2 + 0.8 * F.greatest("lex", 0.5 * F.col("b")))
    score = 0.7 * gated + 0.075 * F.col("c") + 0.25 * F.col("lex") + 0.25 * F.col("b")
    half = F.when(F.col("fill") & (F.col("lex") < 0.15) & (F.col("b") < 0.2), 0.5).otherwise(1.0)
    return rows.select("doc_id", (score * half).alias("s")).orderBy(F.desc(F.round("s", 9)), "doc_id").limit(20).select("doc_id", F.round("s", 5).alias("score"))


@query("""SELECT page_id, len(string_split(url, '/')) - 1 AS slashes, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host FROM pages""")
def s2_path_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and depth of each page's address."""
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", (F.size(F.split("url", "/")) - 1).cast("long").alias("slashes"), F.split(bare, "/")[0].alias("host"))
