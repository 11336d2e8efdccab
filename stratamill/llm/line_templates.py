"""Line dedup by a log-template tree, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.common import SPACE, materialize, null_safe, salted

FIELD = "<*>"


def without(lines: Column, gone: Column) -> Column:
    """The elements of lines that aren't at the rising places gone; each is touched once."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(-1)), gone)
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def line_templates(docs: DataFrame, depth: int = 2, share: int = 50, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, kept for each row of docs, kept being the text without lines of recurring templates.

    A tree of fixed depth sends a line to a leaf by its number of tokens and then its first depth tokens, tokens with
    a digit being fields. In a leaf, a token that min_docs lines or more have at a position is a constant there, all
    others are fields too: the line with its fields generalised is its template, so a leaf has as many templates as
    its lines need, and a line repeated in full is one of them. A template recurs if lines of min_docs documents or
    more have it and, of their tokens after the leading ones that have no digit, one at least and share percent are
    constants; where there are no tokens after the leading ones, one without a digit is enough. Lines of recurring
    templates go.

    Lines without a token stay and aren't counted; a null text has no lines and stays null, an empty one stays empty.
    Documents count by id, null being one; repeated rows count once and lose the same lines. Other columns are ignored. An empty
    table gives no rows.

    Leaves are counted first, in partial sums, and only lines of leaves on min_docs documents are taken apart. Constants
    and templates go to their lines by broadcast where they are few, else by a salted join, so no leaf is one task's.
    """
    text = F.col(text_col)
    lines = docs.filter(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    # tokens are only looked into where a leaf or a template needs it
    fields = lambda w: F.transform(w, lambda x: F.when(x.rlike("[0-9]"), FIELD).otherwise(x))
    lines = lines.withColumn("w", F.array_remove(F.split("raw", f"{SPACE}+"), "")).filter("size(w) > 0")
    leaf = F.xxhash64(F.size("w"), fields(F.slice("w", 1, depth)))
    leaves = lines.select(leaf.alias("leaf"), "id").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    near = salted(lines.withColumn("leaf", leaf), materialize(leaves.select("leaf")), ["leaf"]).select("leaf", "id", "key", "line", fields(F.col("w")).alias("w"))
    near = materialize(near.withColumn("look", F.xxhash64("w")))
    if not near.groupBy("id", "key", "line").count().filter("count > 1").isEmpty():
        near = materialize(near.dropDuplicates(["id", "key", "line"]))
    # lines of a leaf that look alike are taken apart once
    looks = materialize(near.groupBy("leaf", "look").agg(F.count("*").alias("lines"), F.first("w").alias("w")))
    cells = looks.select("leaf", "look", "lines", F.size("w").alias("n"), F.posexplode("w").alias("at", "token"))
    constants = materialize(cells.filter(F.col("token") != FIELD).groupBy("leaf", "at", "token").agg(F.sum("lines").alias("lines")).filter(F.col("lines") >= min_docs).select("leaf", "at", "token"))
    marked = salted(cells.drop("lines"), constants.withColumn("constant", F.lit(1)), ["leaf", "at", "token"], "left")
    after = F.when(F.col("at") >= depth, 1).otherwise(0)
    template = F.bit_xor(F.xxhash64("at", F.when(F.col("constant") == 1, F.col("token")).otherwise(FIELD))).alias("template")
    parsed = marked.groupBy("leaf", "look", "n").agg(template, F.sum(after * F.coalesce("constant", F.lit(0))).alias("fixed"), F.sum(after * (F.col("token") != FIELD).cast("int")).alias("words"), F.max(F.col("token") != FIELD).alias("named"))
    firm = F.when(F.col("n") > depth, (F.col("fixed") > 0) & (100 * F.col("fixed") >= share * F.col("words"))).otherwise(F.col("named"))
    parsed = materialize(parsed.filter(firm).select("leaf", "look", "template"))
    parsed = materialize(salted(near.select("leaf", "look", "id", "key", "line"), parsed, ["leaf", "look"]).drop("look"))
    recurring = parsed.select("leaf", "template", "id").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    gone = salted(parsed, materialize(recurring.select("leaf", "template")), ["leaf", "template"]).groupBy(F.col("id").alias(id_col), F.col("key").alias("_key")).agg(F.array_sort(F.collect_set("line")).alias("_gone"))
    rows = null_safe(docs.select(id_col, text_col).withColumn("_key", F.xxhash64(text)), gone, [id_col, "_key"], "left")
    # the one element of an array binds its lines, which are split once
    own = F.array(F.split(text, "\n"))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.transform(own, lambda x: F.array_join(without(x, F.col("_gone")), "\n"))[0])
    full = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    zero = F.lit(0).cast("long")
    return rows.select(id_col, F.when(text.isNull(), zero).otherwise(full.cast("long")).alias("n_lines"), F.coalesce(F.size("_gone").cast("long") * F.when(F.col("_gone").isNotNull(), 1), zero).alias("n_dropped"), kept.alias("kept"))
