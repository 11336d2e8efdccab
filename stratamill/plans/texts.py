"""Text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.functions import text as X
from stratamill.plans.catalog import catalog
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

SQL_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
PROJECTED = rf"list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_./+-]*'), lambda t: trim(t, '._-')), lambda t: length(t) >= 2 AND NOT list_contains({SQL_LIST(X.STOP_WORDS)}, t))"
LEXICAL = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({{}}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda t: t <> '' AND NOT list_contains({SQL_LIST(X.LEXICAL_STOP)}, t)))"
TRIGRAMS = r"list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i::INT, 3)))"
TURNS = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations QUALIFY before IS NOT NULL"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn beside the one before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rows.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_features, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {PROJECTED} AS t FROM documents)")
def f2_projection_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection tokens of each text."""
    t = X.projection_tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_features"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"""SELECT doc_id, array_to_string(list_filter({SQL_LIST(sorted(X.INTERFACE))}, lambda v: len(list_filter(t, lambda x: starts_with(x, v) OR (starts_with(v, x) AND length(x) >= 4))) > 0), ',') AS hits
FROM (SELECT doc_id, list_distinct({PROJECTED}) AS t FROM documents)""")
def f4_interface_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface words that each text touches."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(X.projection_tokens(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.array_join(X.interface_hits(F.col("t")), ",").alias("hits"))


@query(f"""SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard,
CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) END AS dice
FROM (SELECT conv_id, turn, {LEXICAL.format("text")} AS a, {LEXICAL.format("before")} AS b FROM ({TURNS}))""")
def f5_lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard and Dice similarity of the words of consecutive turns; two empty sets are equal."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", X.lexical_tokens(F.col("text")).alias("a"), X.lexical_tokens(F.col("before")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("conv_id", "turn", F.round(X.jaccard(a, b, 1.0), 6).alias("jaccard"), F.round(X.dice(a, b), 6).alias("dice"))


@query(rf"""SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM (
SELECT conv_id, turn, {TRIGRAMS.format("x")} AS a, {TRIGRAMS.format("y")} AS b FROM (
SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x, trim(regexp_replace(lower(before), '\s+', ' ', 'g')) AS y FROM ({TURNS})))""")
def f6_trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the character trigrams of consecutive turns; two empty sets have none."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", X.trigrams(F.col("text")).alias("a"), X.trigrams(F.col("before")).alias("b"))
    return rows.select("conv_id", "turn", F.round(X.jaccard(F.col("a"), F.col("b"), 0.0), 6).alias("similarity"))


@query(r"""SELECT conv_id, turn, CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0.0 ELSE round(len(list_intersect(q, d)) / len(q), 6) END AS overlap FROM (
SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(before), '[a-z0-9_]{3,}')) AS q, list_distinct(regexp_extract_all(lower(substr(text, 1, 800)), '[a-z0-9_]{3,}')) AS d FROM (
SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations QUALIFY before IS NOT NULL))""")
def f7_query_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the words of a turn that the next turn's first 800 characters take up."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", X.retrieval_tokens(F.col("before")).alias("q"), X.retrieval_tokens(F.substring("text", 1, 800)).alias("d"))
    share = F.when((F.size("q") == 0) | (F.size("d") == 0), 0.0).otherwise(F.size(F.array_intersect("q", "d")) / F.size("q"))
    return rows.select("conv_id", "turn", F.round(share, 6).alias("overlap"))


TAG_SQL = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {k!r})' for k in keys)} THEN '{tag}' END" for tag, keys in X.TAGS.items())


@query(rf"""
WITH part AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(\s*\d+\.(?:\d+\.)?\s+[A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: length(p) >= 80)) AS p,
              generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(\s*\d+\.(?:\d+\.)?\s+[A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: length(p) >= 80), 1) AS s FROM documents),
win AS (SELECT doc_id, s, pos, substr(p, pos + 1, 1200) AS text FROM (SELECT doc_id, s, p, unnest(range(0, length(p), 1200)) AS pos FROM part)),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, pos) AS i, text, lower(text) AS low, regexp_extract(text, '^(\d+\.(?:\d+\.)?\s+[^\n.]{{5,80}})', 1) AS titled FROM win WHERE length(text) >= 60)
SELECT doc_id, printf('C%04d', i) AS chunk_id, CASE WHEN titled <> '' THEN 'section' ELSE 'window' END AS kind,
       trim(CASE WHEN titled <> '' THEN titled WHEN starts_with(text, '```') OR starts_with(text, '---') THEN 'untitled' ELSE substr(text, 1, 80) END) AS title,
       length(text) AS n_chars, concat_ws(',', {TAG_SQL}) AS tags, md5(text) AS text_md5 FROM c""")
def f11_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each text with their titles and tags."""
    found = X.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumn("text_md5", F.md5("text")).drop("text")


CHROME_SQL = "text"
for _p in X.CHROME:
    CHROME_SQL = f"regexp_replace({CHROME_SQL}, '{_p}', '', 'g')"
CHROME_SQL = rf"regexp_replace(regexp_replace({CHROME_SQL}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, length({CHROME_SQL}) AS n_chars, md5({CHROME_SQL}) AS text_md5 FROM documents")
def f12_strip_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without prompt wrappers."""
    t = X.strip_chrome(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(rf"""SELECT conv_id, turn, length(t) < 2 OR regexp_matches(t, '{X.PLACEHOLDER}') AS placeholder,
length(t) < 12 OR (regexp_matches(t, '{X.FILLER}') AND length(t) < 120) OR ((contains(t, '...') OR contains(t, '…')) AND length(t) < 40) AS filler
FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations)""")
def f15_placeholder_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that say nothing."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.is_placeholder(F.col("text")).alias("placeholder"), X.is_filler(F.col("text")).alias("filler"))


@query(r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE greatest(floor(len(regexp_extract_all(t, '\S+')) * 1.3), greatest(1, length(t) // 4)) END::BIGINT AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def f17_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))


@query(rf"""SELECT doc_id, substr(sha256('domain|documents|' || array_to_string(list_sort(list_distinct({PROJECTED})), ' ')), 1, 16) AS fingerprint FROM documents""")
def f24_feature_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short digest of each text's set of features."""
    t = F.array_sort(F.array_distinct(X.projection_tokens(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("domain|documents|"), F.array_join(t, " ")), 256), 1, 16).alias("fingerprint"))


HITS = f"list_filter({SQL_LIST(sorted(X.INTERFACE))}, lambda v: len(list_filter({{0}}, lambda x: starts_with(x, v) OR (starts_with(v, x) AND length(x) >= 4))) > 0)"
BOTH_EMPTY = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"


@query(f"""SELECT conv_id, turn, round(align, 6) AS align, CASE WHEN (align >= 0.42 AND n >= 2) OR (law >= 3 AND ij >= 0.2) THEN 'glue_ok' WHEN align >= 0.22 OR law >= 2 OR n >= 4 THEN 'partial_section' ELSE 'frustrated' END AS regime FROM (
SELECT *, 0.65 * ij + 0.35 * fj AS align FROM (
SELECT conv_id, turn, {BOTH_EMPTY.format("ia", "ib")} AS ij, {BOTH_EMPTY.format("a", "b")} AS fj, len(list_intersect(ia, ib)) AS n, len(list_intersect(list_intersect(ia, ib), {SQL_LIST(X.LAW_CORE)})) AS law FROM (
SELECT *, {HITS.format("a")} AS ia, {HITS.format("b")} AS ib FROM (
SELECT conv_id, turn, list_distinct({PROJECTED}) AS a, list_distinct({PROJECTED.replace("text", "before")}) AS b FROM ({TURNS})))))""")
def p20_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of consecutive turns on the interface words and on all features, and its regime."""
    tokens = {k: F.array_distinct(X.projection_tokens(F.col(c))).alias(k) for k, c in (("a", "text"), ("b", "before"))}
    rows = turns(spark, sf_dir).select("conv_id", "turn", *tokens.values())
    rows = rows.withColumns({"ia": X.interface_hits(F.col("a")), "ib": X.interface_hits(F.col("b"))})
    both, shared = F.array_intersect("ia", "ib"), X.jaccard(F.col("ia"), F.col("ib"), 1.0)
    rows = rows.withColumns({"align": 0.65 * shared + 0.35 * X.jaccard(F.col("a"), F.col("b"), 1.0), "n": F.size(both), "law": F.size(F.array_intersect(both, X.words_of(X.LAW_CORE))), "ij": shared})
    glue = ((F.col("align") >= 0.42) & (F.col("n") >= 2)) | ((F.col("law") >= 3) & (F.col("ij") >= 0.2))
    partial = (F.col("align") >= 0.22) | (F.col("law") >= 2) | (F.col("n") >= 4)
    regime = F.when(glue, "glue_ok").when(partial, "partial_section").otherwise("frustrated")
    return rows.select("conv_id", "turn", F.round("align", 6).alias("align"), regime.alias("regime"))


@query(r"""SELECT count(*) AS leaked FROM benchmark b WHERE trim(regexp_replace(lower(text), '\s+', ' ', 'g')) IN (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) FROM documents)""")
def j15_heldout_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts that are documents too, by normalised text."""
    key = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("key")
    held = table(spark, sf_dir, "benchmark").select(key)
    return held.join(table(spark, sf_dir, "documents").select(key), "key", "left_semi").agg(F.count("*").alias("leaked"))


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 12")
def t6_per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve longest documents of each source."""
    ranked = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("_r", F.row_number().over(ranked)).filter("_r <= 12").drop("_r")


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 20000""")
def t5_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that fit a budget of characters, up to the first that doesn't."""
    run = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.sum("n_chars").over(run).alias("used")).filter("used <= 20000")
