"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm.common import WORD, materialize, null_safe, running, small

#: Weight over training time for each class of sources, as knots (time, weight) with straight lines between them.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))


def when_reached(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule has used up the share u of its integral: a quadratic on each straight piece."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, t1 - t0, w0, w1, area))
        area += (w0 + w1) / 2 * (t1 - t0)
    out = None
    for t0, h, w0, w1, before in reversed(pieces):
        need = F.greatest(u * area - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * (w1 - w0) / h * need, F.lit(0.0)))
        t = F.lit(t0) + F.least(2 * need / (w0 + root), F.lit(h)) if w0 or w1 else F.lit(t0)
        out = t if out is None else F.when(u * area < before + (w0 + w1) / 2 * h, t).otherwise(out)
    return out


def targets(sizes: DataFrame, source_col: str, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """(source, source_size, class, target) from a written table sizes (source, source_size).

    Sources by code point, null last, have the weights in turn and share total times all sizes; none gets more than
    most times its own size, and what it can't take is shared by weight among the others. Sorted by size over weight
    the full sources come first, so running sums give the level at which nothing is above, without repetition.
    Ranks and sums go over range-sorted sources; only the sums and the level come to the driver.
    """
    rows = running(sizes, [], [F.col(source_col).asc_nulls_last()], F.lit(1).cast("long"), "_rank").withColumn("class", F.col("_rank") % len(weights))
    rows = rows.withColumn("_w", F.array(*(F.lit(float(w)) for w in weights))[F.col("class")])
    rows = rows.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rows = materialize(running(rows, [], [F.col("_ratio"), F.col("_rank")], [F.col("_cap"), F.col("_w")], ["_caps", "_ws"]))
    whole = rows.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    here = (F.lit(float(total) * (whole["size"] or 0)) - F.col("_caps")) / (F.lit(whole["w"]) - F.col("_ws"))
    found = rows.withColumn("_level", here).filter("_level <= _ratio").agg(F.min(F.struct("_ratio", "_rank", "_level"))["_level"]).first()[0]
    level = F.col("_cap") if found is None else F.lit(found) * F.col("_w")
    return rows.select(source_col, "source_size", "class", F.least("_cap", level).alias("target"))


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, schedules=SCHEDULES
) -> DataFrame:
    """id, source, size, source_size, target, taken, takes and position for each row of docs, sorted by position.

    size counts words (null: 0). A source's documents stand in an order fixed by a digest of their id and are gone
    through up to ceil(most) times until the source's target is used up; taken is what that covers of a document, so
    the sum of taken is the target rounded and no document exceeds most times its size. takes holds, for each time
    that words of a document are taken, how many, its first ones, and the training time from 0 to 1 at which the
    source's schedule, integrated, has demanded the words before their middle; position is the first such time.
    Documents that aren't taken come last. A null source is a source; repeated rows count each; empty documents take
    no words. Other columns are ignored; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col), F.col(source_col), size.alias("size"), F.md5(F.col(id_col).cast("string")).alias("_h"))
    rows = running(rows, [source_col], ["_h", id_col, "size"], F.col("size"), "_c")
    rows = materialize(rows)
    sums = materialize(rows.groupBy(source_col).agg(F.sum("size").alias("source_size")))
    aims = small(materialize(targets(sums, source_col, weights, total, most)))
    rows = null_safe(rows, aims, [source_col])
    goal = F.round("target").cast("long")
    zero, taken, times = F.lit(0).cast("long"), F.lit(0).cast("long"), []
    for k in range(-int(-most // 1)):
        start = F.col("_c") + k * F.col("source_size")
        part = F.least(F.greatest(goal - start, zero), F.col("size"))
        taken = taken + part
        u = (start + part / 2) / goal
        when = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            when = F.when(F.col("class") == i % len(schedules), when_reached(u, knots)).otherwise(when)
        times.append(F.when(part > 0, F.struct(when.alias("position"), part.alias("words"))))
    rows = rows.withColumn("taken", taken).withColumn("takes", F.array_compact(F.array(*times)))
    rows = rows.withColumn("position", F.try_element_at("takes", F.lit(1))["position"])
    return rows.select(id_col, source_col, "size", "source_size", "target", "taken", "takes", "position").orderBy(F.col("position").asc_nulls_last(), id_col)
