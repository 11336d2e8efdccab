"""Joins of points in the plane by a grid, and connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells are a little wider than the radius, so that rounding never puts two partners more than one cell apart.
SLACK = 1.001
#: Pairs of points of two cells that are compared one by one; cells with more are halved.
FEW = 256


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names or, where it names none and runs on one machine, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None and (named := spark.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(named)
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stratamill-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in folder()."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written to folder() and read again. A checkpoint hands on what the plan behind it knows of its columns, which
    doubles from round to round until the driver is full; a file doesn't."""
    path = f"{folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def radius_join(left: DataFrame, right: DataFrame, r: float) -> DataFrame:
    """a, b, d2 (squared distance) of the points (id, x, y) of left and right that are at most r apart.

    An equi-join on grid cells: points of the right stand in the nine cells around their own.
    """
    cell = lambda c: F.floor(F.col(c) / (r * SLACK))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = left.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = right.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), around("x").alias("cx"))
    b = b.withColumn("cy", around("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.join(b, ["cx", "cy"]).select("a", "b", (dx * dx + dy * dy).alias("d2")).filter(F.col("d2") <= r * r)


def nearest(queries: DataFrame, points: DataFrame, r: float, k: int = 1) -> DataFrame:
    """a, rank, b, d2: the k points nearest to each query (another id), by distance and then id.

    Queries that find fewer than k points within r try again with twice the radius, so each round handles what is
    left. Queries are given up only when r exceeds the extent of all points, which two aggregates bound.
    """
    every = queries.select("x", "y").union(points.select("x", "y"))
    low_x, high_x, low_y, high_y = every.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    out, todo = None, queries.filter("x IS NOT NULL AND y IS NOT NULL")
    by = Window.partitionBy("a").orderBy("d2", "b")
    while True:
        last = low_x is None or r >= high_x - low_x + high_y - low_y
        found = radius_join(todo, points, r).filter("a <> b").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        found = cut(found.withColumn("_n", F.count("*").over(Window.partitionBy("a"))))
        done = (found if last else found.filter(F.col("_n") == k)).select("a", "rank", "b", "d2")
        out = done if out is None else out.union(done)
        if last:
            return out
        todo = cut(todo.join(done.select(F.col("a").alias("id")), "id", "left_anti"))
        if todo.isEmpty():
            return out
        r *= 2


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (the least id that can be reached) of nodes (id) by edges (a, b).

    Each round gives a node, and the node that is its label, the least label among its neighbours, and then the label of
    that label: whole trees of labels hang on each other instead of labels going from neighbour to neighbour (FastSV,
    Zhang, Azad and Hu, 2020). It ends when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = written(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(now, both["b"] == now["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = now.join(near, now["id"] == near["a"], "left").select("id", "component", "near")
        hook = step.groupBy(F.col("component").alias("top")).agg(F.min("near").alias("hook"))
        step = step.join(hook, step["id"] == hook["top"], "left").select("id", F.least("component", "near", "hook").alias("to"), F.col("component").alias("before"))
        label = now.select(F.col("id").alias("to"), F.col("component").alias("jump"))
        after = written(step.join(label, "to").select("id", F.least("to", "jump").alias("component"), "before"))
        now = after.select("id", "component")
        if after.filter("component <> before").isEmpty():
            return now


def floor(c: Column) -> Column:
    """The floor as a double; of numbers without a fraction themselves, whatever their size."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def outermost(places: DataFrame, k: int) -> DataFrame:
    """cx, cy, n, id (the least) of the cells of places (id, x, y, u, v), 2^k to a unit of u and v, and the places x0, y0 furthest west, x1, y1 east, x2, y2 south and x3, y3 north."""
    ends = [F.min("x"), F.min_by("y", "x"), F.max("x"), F.max_by("y", "x"), F.min_by("x", "y"), F.min("y"), F.max_by("x", "y"), F.max("y")]
    cells = places.groupBy(floor(F.col("u") * 2.0**k).alias("cx"), floor(F.col("v") * 2.0**k).alias("cy"))
    return cells.agg(F.min("id").alias("id"), F.count("*").alias("n"), *(e.alias(f"{'xy'[i % 2]}{i // 2}") for i, e in enumerate(ends)))


def side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns))


def judged(pairs: DataFrame, r: float) -> DataFrame:
    """The pairs of cells (a_ and b_ columns of outermost) that may have points at most r apart; hit: two of their outermost
    points are. Differences, squares and sums of doubles keep their order, so no box is put further away than its points."""
    d2 = lambda x, y: x * x + y * y
    gap = lambda low, high: F.greatest(F.lit(0.0), F.col(f"b_{low}") - F.col(f"a_{high}"), F.col(f"a_{low}") - F.col(f"b_{high}"))
    closest = F.least(*(d2(F.col(f"a_x{i}") - F.col(f"b_x{j}"), F.col(f"a_y{i}") - F.col(f"b_y{j}")) for i in range(4) for j in range(4)))
    return pairs.filter(d2(gap("x0", "x1"), gap("y2", "y3")) <= r * r).withColumn("hit", closest <= r * r)


def classes(points: DataFrame, r: float) -> DataFrame:
    """id, component (the least id that chains of points at most r apart reach) of points (id, x, y), a row for each id.

    Points of one cell are at most r apart, so cells are linked instead of points, and copies or dense cells make no
    pairs. Two cells are linked if two of their outermost points are; they needn't be if a third cell links them or
    their boxes are further apart. All other pairs of cells are settled point by point where there are few, else by
    cells of half the width, again and again. Points without a finite place, or without an id, link with nothing.
    """
    unit, finite = r / math.sqrt(2) / SLACK, F.lit(math.inf)
    points = written(points.select("id", "x", "y", F.coalesce((F.abs("x") < finite) & (F.abs("y") < finite) & F.col("id").isNotNull(), F.lit(False)).alias("linked")))
    scaled = lambda df: df.withColumn("u", F.col("x") / unit).withColumn("v", F.col("y") / unit)
    places = written(scaled(points.filter("linked").groupBy("x", "y").agg(F.min("id").alias("id"))))
    cells = written(outermost(places, 0))

    # the cells that partners of a cell can be in, each pair once
    ahead = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    steps = F.explode(F.array(*(F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i, j in ahead)))
    near = cells.select("cx", "cy", F.col("id").alias("a_id"), steps.alias("s")).select("a_id", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    near = near.join(cells.select("cx", "cy", F.col("id").alias("b_id")), ["cx", "cy"]).filter("a_id <> b_id").select("a_id", "b_id")
    pairs = near.join(side(cells, "a"), "a_id").join(side(cells, "b"), "b_id")
    ends = ["a", "b", "a_cx", "a_cy", "b_cx", "b_cy", "a_n", "b_n"]
    seen = written(judged(pairs, r).withColumns({"a": F.col("a_id"), "b": F.col("b_id")}).select(*ends, "hit"))
    links = seen.filter("hit").select("a", "b")
    both = links.union(links.select("b", "a"))
    closed = seen.filter("NOT hit").select("a", "b").join(both.toDF("a", "c"), "a").join(both.toDF("c", "b"), ["c", "b"], "left_semi").select("a", "b").distinct()
    todo = written(seen.filter("NOT hit").drop("hit").join(closed, ["a", "b"], "left_anti"))

    k, few = 0, F.col("a_n") * F.col("b_n") <= FEW
    while True:
        n_few, n_more = todo.agg(F.count_if(few), F.count_if(~few)).first()
        if n_few:
            at = places.select(floor(F.col("u") * 2.0**k).alias("cx"), floor(F.col("v") * 2.0**k).alias("cy"), "x", "y")
            single = todo.filter(few).join(side(at, "a"), ["a_cx", "a_cy"]).join(side(at, "b"), ["b_cx", "b_cy"])
            dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
            links = links.union(written(single.filter(dx * dx + dy * dy <= r * r).select("a", "b").distinct()))
        if not n_more:
            break
        more = todo.filter(~few).join(links, ["a", "b"], "left_anti")
        held = more.select(F.col("a_cx").alias("px"), F.col("a_cy").alias("py")).union(more.select("b_cx", "b_cy")).distinct()
        inside = places.withColumns({"px": floor(F.col("u") * 2.0**k), "py": floor(F.col("v") * 2.0**k)}).join(held, ["px", "py"], "left_semi")
        k += 1
        half = written(outermost(inside, k)).withColumns({"px": floor(F.col("cx") / 2), "py": floor(F.col("cy") / 2)})
        pairs = more.select("a", "b", F.col("a_cx").alias("a_px"), F.col("a_cy").alias("a_py"), F.col("b_cx").alias("b_px"), F.col("b_cy").alias("b_py"))
        pairs = pairs.join(side(half, "a"), ["a_px", "a_py"]).join(side(half, "b"), ["b_px", "b_py"])
        seen = written(judged(pairs, r).select(*ends, "hit"))
        hits = written(seen.filter("hit").select("a", "b").distinct())
        links = links.union(hits)
        todo = written(seen.filter("NOT hit").drop("hit").join(hits, ["a", "b"], "left_anti"))

    found = components(cells.select("id").distinct(), links)
    of = cells.select("cx", "cy", "id").join(found, "id").select("cx", "cy", "component")
    own = scaled(points.filter("linked")).select("id", floor(F.col("u")).alias("cx"), floor(F.col("v")).alias("cy")).join(of, ["cx", "cy"]).select("id", "component")
    own = own.union(points.filter("NOT linked").select("id", F.col("id").alias("component")))
    least = written(own.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("most")))
    split = least.filter("component < most")
    if split.isEmpty():
        return least.select("id", "component")
    # rows of one id in several components
    ties = own.withColumnRenamed("component", "b").join(split.select("id", F.col("component").alias("a")), "id").select("a", "b").distinct()
    whole = components(own.filter("id IS NOT NULL").select(F.col("component").alias("id")).distinct(), ties).toDF("component", "root")
    return least.join(whole, "component", "left").select("id", F.col("root").alias("component"))
