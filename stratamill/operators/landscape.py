"""How well two binned logs agree at each of many offsets, as joins and aggregates of their cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Halves of a unit tried on either side, weights of shape and slope beside the location, cells that must
# overlap, widest gap in cells, taps of the smoothing on either side; offsets that must have a cost, the least scale of
# the costs, the steps by which costs count as low, and the width where there is no minimum.
HALVES, SHAPE, SLOPE, LEAST_CELLS, GAP, TAPS = 60, 0.30, 0.20, 6, 2, 4
LEAST_OFFSETS, LEAST_SPREAD, LOW_SHARE, LOW, NO_WIDTH = 5, 0.05, 0.25, 0.03, 60.0


def quartile_cells(rows: DataFrame, key: str, width: float) -> DataFrame:
    """key, side, cell, a, b, c of rows (key, side, x, value): quartiles by cell, as many rows as the span has cells."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    cells = rows.groupBy(key, "side", F.rint(F.col("x") / width).cast("long").alias("cell")).agg(q.alias("q"))
    return cells.select(key, "side", "cell", *(F.col("q")[i].alias(n) for i, n in enumerate("abc")))


def spans(cells: DataFrame, key: str) -> DataFrame:
    """Each unit interval (at, at + 1] between neighbouring cells that are GAP apart or less, with the quartiles of both
    ends; the first cell has an interval whose ends are itself."""
    by_cell = Window.partitionBy(key).orderBy("cell")
    ends = cells.select(key, "cell", *"abc", *(F.lag(c).over(by_cell).alias(f"{c}0") for c in ("cell", *"abc")))
    ends = ends.select(key, F.coalesce("cell0", "cell").alias("from"), F.col("cell").alias("to"), *(F.coalesce(f"{c}0", c).alias(f"{c}0") for c in "abc"), *(F.col(c).alias(f"{c}1") for c in "abc"))
    ends = ends.filter(F.col("to") - F.col("from") <= GAP)
    return ends.withColumn("at", F.explode(F.when(F.col("from") == F.col("to"), F.array(F.col("to") - 1)).otherwise(F.sequence("from", F.col("to") - 1))))


def smoothed(c: str, by_cell) -> Column:
    """Gaussian mean of neighbouring cells with a deviation of one cell; beyond the ends the end counts."""
    taps = [math.exp(-0.5 * d * d) for d in range(-TAPS, TAPS + 1)]
    whole = by_cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = [w / sum(taps) * F.coalesce(F.lag(c, -d).over(by_cell), F.first(c).over(whole) if d < 0 else F.last(c).over(whole)) for d, w in zip(range(-TAPS, TAPS + 1), taps)]
    return sum(parts[1:], parts[0])


def offset_costs(query: DataFrame, reference: DataFrame, key: str, width: float) -> DataFrame:
    """key, offset, cells, cost of cells (key, cell, a, b, c); only offsets at which enough of the query meets the reference.

    Costs add the median difference of quartiles over the reference's scale, the lack of correlation of smoothed
    medians, and the median difference of their slopes over scale and width. The scale is the spread between the quartiles
    of the reference's medians, 1 at least.
    """
    scale = reference.groupBy(key).agg(F.count("*").alias("_n"), F.percentile("b", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    scale = scale.select(key, F.when(F.col("_n") < 4, 1.0).otherwise(F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1.0))).alias("scale"))
    tried = query.withColumn("half", F.explode(F.sequence(F.lit(-HALVES), F.lit(HALVES)))).withColumn("p", F.col("cell") + F.col("half") / 2 / width)
    met = tried.withColumn("at", (F.ceil("p") - 1).cast("long")).join(spans(reference, key), [key, "at"]).filter((F.col("p") >= F.col("from")) & (F.col("p") <= F.col("to")))
    share = F.when(F.col("to") > F.col("from"), (F.col("p") - F.col("from")) / (F.col("to") - F.col("from"))).otherwise(0.0)
    value = lambda c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * share
    met = met.join(scale, key).select(key, "half", "cell", "scale", F.col("b").alias("x"), value("b").alias("y"), (sum(F.abs(F.col(c) - value(c)) for c in "abc") / 3).alias("away"))
    by_cell = Window.partitionBy(key, "half").orderBy("cell")
    met = met.select("*", smoothed("x", by_cell).alias("sx"), smoothed("y", by_cell).alias("sy"))
    steps = met.select("*", (F.col("cell") - F.lag("cell").over(by_cell)).alias("step"), *((F.col(c) - F.lag(c).over(by_cell)).alias(f"d{c}") for c in ("sx", "sy")))
    near = F.col("step") <= GAP
    steep = F.when(near, F.abs(F.col("dsx") - F.col("dsy")) / (F.col("step") * width))
    found = steps.groupBy(key, "half", "scale").agg(
        F.count("*").alias("cells"), F.percentile("away", 0.5).alias("away"), F.corr("sx", "sy").alias("r"), F.least(F.stddev_pop("sx"), F.stddev_pop("sy")).alias("flat"), F.percentile(steep, 0.5).alias("steep"), F.count_if(near).alias("near")
    )
    bent = F.col("flat") > 1e-8
    shape = F.when(bent, 1 - F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.0))).otherwise(1.0)
    slope = F.when(bent & (F.col("near") >= 3), F.col("steep") / F.greatest(F.col("scale") / width, F.lit(1e-6))).otherwise(1.0)
    cost = F.col("away") / F.col("scale") + SHAPE * shape + SLOPE * slope
    return found.filter(F.col("cells") >= LEAST_CELLS).select(key, (F.col("half") / 2).alias("offset"), "cells", cost.alias("cost"))


def landscape(costs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """For each of keys the best offset, a softened one, how sharp and wide the minimum is; null where too few offsets have a cost."""
    least = F.min(F.struct(F.round("cost", 9).alias("_c"), "offset", "cost", "cells"))
    middle = costs.groupBy(key).agg(F.count("*").alias("n"), F.percentile("cost", 0.5).alias("mid"), least.alias("k")).filter(F.col("n") >= LEAST_OFFSETS)
    both = costs.join(middle.select(key, "mid", F.col("k.cost").alias("low"), F.col("k.offset").alias("best"), F.col("k.cells").alias("at")), key)
    spread = both.groupBy(key).agg(F.percentile(F.abs(F.col("cost") - F.col("mid")), 0.5).alias("mad"))
    both = both.join(spread, key)
    weight = F.exp(-F.least((F.col("cost") - F.col("low")) / F.greatest("mad", F.lit(LEAST_SPREAD)), F.lit(50.0)))
    low = F.when(F.col("cost") <= F.col("low") + F.greatest(LOW_SHARE * F.col("mad"), F.lit(LOW)), F.col("offset"))
    found = both.groupBy(key, "best", "at", "mid", "low", "mad").agg((F.sum(weight * F.col("offset")) / F.sum(weight)).alias("soft"), (F.max(low) - F.min(low)).alias("_width"))
    found = found.withColumn("_sharp", (F.col("mid") - F.col("low")) / F.greatest("mad", F.lit(1e-6)))
    edge = F.when(F.abs("best") >= HALVES / 2 - 0.01, 1.0).otherwise(0.0)
    none = F.col("best").isNull()
    return keys.join(found, key, "left").select(
        key, "best", "soft", F.when(none, 0.0).otherwise(F.col("_sharp")).alias("sharpness"), F.when(none, NO_WIDTH).otherwise(F.col("_width")).alias("width"),
        F.coalesce("at", F.lit(0)).cast("long").alias("cells"), F.when(none, 1.0).otherwise(edge).alias("at_edge"),
    )
