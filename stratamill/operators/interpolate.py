"""As-of interpolation of ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate(points: DataFrame, queries: DataFrame, key: str, x: str, y: str, max_gap: float) -> DataFrame:
    """key, x, y, bounded for each row of queries (key, x): linear between the points on either side, held at the ends.

    bounded is null where no point lies on one side or the points are more than max_gap apart. Points of one x count
    by their least y. A union and one window by key replace a range join. Null x or y are left out.
    """
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, x).agg(F.min(y).alias("_y"))
    both = known.select(key, x, F.struct(F.col(x).alias("x"), F.col("_y").alias("y")).alias("_p")).unionByName(queries.select(key, x, F.lit(None).alias("_p")))
    by = Window.partitionBy(key).orderBy(x)
    lo = F.last("_p", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0))
    hi = F.first("_p", ignorenulls=True).over(by.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_lo": lo, "_hi": hi}).filter("_p IS NULL")
    gap = F.col("_hi.x") - F.col("_lo.x")
    line = F.col("_lo.y") + (F.col("_hi.y") - F.col("_lo.y")) * (F.col(x) - F.col("_lo.x")) / F.nullif(gap, F.lit(0.0))
    value = F.coalesce(line, F.col("_lo.y"), F.col("_hi.y"))
    return found.select(key, x, value.alias(y), F.when(gap <= max_gap, value).alias("bounded"))
