"""The operators over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.llm import curriculum, exact_dedup, html_extract, language_id, line_templates, ngram_join, packing, sharding, substring_dedup, vector_join
from stratamill.llm.common import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query(r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][k % 3 + 1] AS w, 2.0::DOUBLE * n AS cap, 2.0::DOUBLE * n / [5.0::DOUBLE, 2.0, 1.0][k % 3 + 1] AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, k % 3 AS class, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, k LIMIT 1) * w, cap)) AS target FROM l),
c AS (SELECT doc_id, size, n, class, target, round(target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(least(goal - c, size), 0) AS one, greatest(least(goal - c - n, size), 0) AS two FROM c),
u AS (SELECT *, CASE WHEN one > 0 THEN (c + one / 2.0::DOUBLE) / goal END AS u FROM p)
SELECT doc_id, size, n AS source_size, target, one + two AS taken, round(CASE class WHEN 0 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u)) WHEN 1 THEN u
  ELSE CASE WHEN u * 0.9375 < 0.3125 THEN 2 * (u * 0.9375) / (0.5 + sqrt(0.25 + u * 0.9375)) ELSE 0.5 + 2 * (u * 0.9375 - 0.3125) / (0.75 + sqrt(0.5625 + 4 * (u * 0.9375 - 0.3125))) END END, 9) AS position FROM u
""")
def op2_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in a curriculum that takes sources to their target weights."""
    found = curriculum.curriculum(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


@query()
def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token pieces in sequences of 2048."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), word_tokenizer()))


@query(r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""")
def op5_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op6_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards by jump consistent hashing."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query()
def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without windows of 13 words that start in an earlier one."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


@query()
def op7_grouped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query()
def op9_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by error-correcting output codes."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query()
def op3_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors of a label with a cosine of 0.98 or more."""
    return vector_join.vector_join(table(spark, sf_dir, "embeddings"))


@query()
def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page by its site's style tree."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query(r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM raw),
k AS (SELECT doc_id, i, w, len(w) AS n, w[1:2] AS head FROM l WHERE len(w) > 0),
leaf AS (SELECT n, head FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
near AS (SELECT n, head, doc_id, i, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM k JOIN leaf USING (n, head)),
constant AS (SELECT n, head, pos, token, 1 AS c FROM near WHERE token <> '<*>' GROUP BY n, head, pos, token HAVING count(*) >= 5),
parsed AS (SELECT n, head, doc_id, i, list(CASE WHEN c = 1 THEN token ELSE '<*>' END ORDER BY pos) AS t, count(*) FILTER (WHERE pos > 2 AND c = 1) AS fixed,
           count(*) FILTER (WHERE pos > 2 AND token <> '<*>') AS words, bool_or(token <> '<*>') AS named FROM near LEFT JOIN constant USING (n, head, pos, token) GROUP BY n, head, doc_id, i),
firm AS (SELECT n, head, t, doc_id, i FROM parsed WHERE CASE WHEN n > 2 THEN fixed > 0 AND 100 * fixed >= 50 * words ELSE named END),
recurring AS (SELECT n, head, t FROM firm GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT DISTINCT doc_id, i FROM firm JOIN recurring USING (n, head, t)),
per AS (SELECT raw.doc_id, count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_lines, count(gone.i) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY raw.i) FILTER (WHERE gone.i IS NULL), '') AS kept
        FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.i = gone.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN per USING (doc_id)
""")
def op8_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that follow a template that recurs across documents, and what is left without them."""
    found = line_templates.line_templates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
