"""A training corpus from raw documents: language, exact and near copies, mixture, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.llm import curriculum, exact_dedup, language_id, ngram_join, packing
from stratamill.llm.common import WORD, fresh, keep_rows, materialize, null_safe, running, table
from stratamill.llm.queries import word_tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no letter and those whose language is ambiguous: two codewords are about as near."""
    found = language_id.predict(docs, language_id.fit(docs))
    lang, _, ambiguous = found.columns[-3:]
    return found.filter((F.col(lang) != language_id.UNKNOWN) & ~F.col(ambiguous)).select(*docs.columns)


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def with_own_ids(docs: DataFrame) -> DataFrame:
    """docs with, last, a number of its own for each pair of doc_id and text: doc_id where that is one, else the place by doc_id, null last."""
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn(fresh(docs, "_id"), F.col("doc_id"))
    own, digest = fresh(docs, "_id"), fresh(docs, "_sha256")
    tagged = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    pairs = materialize(tagged.select("doc_id", digest).distinct())
    numbered = running(pairs, [], [F.col("doc_id").asc_nulls_last(), F.col(digest).asc()], F.lit(1).cast("long"), own)
    return materialize(null_safe(tagged, numbered, ["doc_id", digest]).drop(digest))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    Different texts under a null or shared doc_id are documents of their own.
    """
    numbered = with_own_ids(docs)
    own = numbered.columns[-1]
    found = ngram_join.ngram_join(numbered, k=5, percent=80, id_col=own).filter(F.col(own) == F.col("component_id"))
    return keep_rows(numbered, found, [own]).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in curriculum order, each as often as words of it are taken.

    Where a source's target ends within a document, that time of it is cut to its first words, white space being one
    space there, and n_chars, if there is such a column, is that of what stays; so a source's words are its target,
    rounded. Documents that aren't taken go.
    """
    own = with_own_ids(docs)
    key, at, words = own.columns[-1], fresh(own, "_position"), fresh(own, "_words")
    plan = curriculum.curriculum(own, id_col=key).select(key, "size", F.explode("takes").alias("take"))
    plan = plan.select(key, F.col("take.position").alias(at), F.when(F.col("take.words") < F.col("size"), F.col("take.words")).alias(words))
    placed = own.join(materialize(plan.distinct()), key)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col(words).cast("int")), " ")
    placed = placed.withColumn("text", F.when(F.col(words).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        placed = placed.withColumn("n_chars", F.when(F.col(words).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    # written before it is sorted: the sort's sample would join again, and the join's files would stay until its end
    return materialize(placed).orderBy(at, key).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048."""
    return packing.pack(packing.pieces(docs, word_tokenizer()))


STAGES = [("language_id", known_language), ("exact_dedup", one_of_equals), ("ngram_join", one_of_near), ("mixing", mixed), ("packing", packed)]
#: SQL can express neither the classifier nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
