"""What the operators share: scratch tables, distributed running sums, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one where the session names none and runs on one machine, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="stratamill-"))


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor costs no recomputation.

    Numbers dealt by row order, such as spark_partition_id(), are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # once the table is written, the shuffle files behind it are of no use
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores after it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is; df should be a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of which nulls are equal; the right side's copies of them go."""
    renamed = right.select(*(F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns))
    cond = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    return left.join(renamed, cond, how).drop(*(f"_r_{c}" for c in on))


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join of rows with a written table that has each key once: broadcast where it is small, else each key of it stands
    for salts parts of its rows, so that none is one task's."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), list(on), how)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def look_up(rows: DataFrame, info: DataFrame, on: Sequence[str], count: str, support: float = 1e-3) -> DataFrame:
    """rows with the columns of info for their key, null where on has a null or info no such key; a left join.

    info has a row for each key, with how many of rows it has in count. Keys of more than support of all rows, of
    which there are no more than 1 / support, are broadcast, so none of them is one task's.
    """
    total = info.agg(F.sum(count)).first()[0] or 0
    heavy = info.filter(F.col(count) > support * total).withColumn("_heavy", F.lit(True))
    tagged = rows.join(F.broadcast(heavy), list(on), "left")
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    none = tagged.filter("_heavy IS NOT NULL").union(tagged.filter(F.col("_heavy").isNull() & ~whole)).drop("_heavy")
    light = tagged.filter(F.col("_heavy").isNull() & whole).select(*rows.columns)
    return none.unionByName(light.join(info.filter(F.col(count) <= support * total), list(on), "left"))


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: Column | Sequence[Column], name: str | Sequence[str]) -> DataFrame:
    """Adds the sum of value over the earlier rows of the same group; of several values, if there are several names.

    Rows are range-sorted, so a group that holds most rows spans many partitions; what each partition adds to a
    group is one row, and only those rows are summed by group. No group has to fit in a task.
    """
    values, names = ([value], [name]) if isinstance(name, str) else (value, name)
    temp = {f"_v{i}": v for i, v in enumerate(values)}
    ranged = df.withColumns(temp).repartitionByRange(*(F.col(c) for c in group), *order).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged)
    ahead = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_pid", *group).agg(*(F.sum(v).alias(f"_part{v}") for v in temp))
    parts = parts.select("_pid", *group, *(F.coalesce(F.sum(f"_part{v}").over(ahead), F.lit(0)).alias(f"_before{v}") for v in temp))
    here = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: F.col(f"_before{v}") + F.coalesce(F.sum(v).over(here), F.lit(0)) for n, v in zip(names, temp)}
    summed = null_safe(ranged, parts, ["_pid", *group]).withColumns(sums)
    return summed.drop("_pid", *temp, *(f"_before{v}" for v in temp))


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every end of edges (a, b): the smallest id that can be reached.

    Large and small stars in turn (Kiveris et al., 2014): each round links every node's neighbours to their least
    one by a grouped minimum and a join, so no neighbourhood is gathered in a task. Rounds grow with the logarithm
    of the longest path. Only a count and a checksum come to the driver.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = materialize(star.filter("a <> b").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return found.union(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def keep_rows(docs: DataFrame, kept: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of docs whose values of on are in kept, one row for each (null is a value too)."""
    ids = materialize(kept.select(*on).distinct())
    odd = materialize(docs.groupBy(*on).agg(F.count("*").alias("_n")).filter("_n > 1").select(*on))
    if odd.isEmpty():
        return null_safe(docs, ids, on)
    again = null_safe(ids, odd, on)
    once = ids.exceptAll(again)
    return null_safe(docs, once, on).unionByName(null_safe(docs, again, on).dropDuplicates(list(on)))
