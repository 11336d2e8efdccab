"""Exact dedup by heavy-hitter split, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.common import SPACE, fresh, keep_rows, materialize


def text_sha256(text_col: str) -> Column:
    """SHA-256, in lower hex, of a text with each run of white space as one space; null as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", " "), 256).alias("text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with docs' own columns."""
    digest = fresh(docs, "_sha256")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col), F.col("text_sha256").alias(digest))
    tagged = docs.withColumn(digest, text_sha256(text_col))
    return keep_rows(tagged, kept, [id_col, digest]).select(*docs.columns)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """Groups of equal texts: id, keep_id, group_size, kept, text_sha256; a row for each row of docs.

    Texts are equal when their SHA-256 after turning runs of white space into one space is; null counts as empty.
    The row with the smallest id stays (a null id comes last); of rows that share that id, one.

    A Misra-Gries pass (freqItems, at most 1 / support counters) names the digests that may hold over that share of
    rows; a second pass counts them exactly and finds their winners, at most 1 / support rows, which are broadcast so
    that their rows are settled where they are read. All other digests, each below that share, are shuffled.
    Texts never move: only id, digest and row number do. An empty table gives no rows.
    """
    rows = materialize(docs.select(F.col(id_col), text_sha256(text_col), F.monotonically_increasing_id().alias("_row")))
    winner = F.min(F.struct(F.isnull(id_col).alias("none"), F.col(id_col).alias("keep_id"), F.col("_row").alias("row"))).alias("_keep")
    frequent = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    share = rows.count() * support
    heavy = rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(F.count("*").alias("group_size"), winner)
    heavy = materialize(heavy.filter((F.col("group_size") >= share) & (F.col("group_size") > 1)))
    tagged = rows.join(F.broadcast(heavy), "text_sha256", "left")
    light = tagged.filter("group_size IS NULL").select(id_col, "text_sha256", "_row")
    groups = light.groupBy("text_sha256").agg(F.count("*").alias("group_size"), winner)
    both = tagged.filter("group_size IS NOT NULL").unionByName(light.join(groups, "text_sha256"))
    return both.select(id_col, "_keep.keep_id", "group_size", (F.col("_row") == F.col("_keep.row")).alias("kept"), "text_sha256")
