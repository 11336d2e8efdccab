"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamill.llm.common import components, look_up, materialize, running

#: Leading principal dimensions of the grid and of bounds, rows of a block and of an interval that is compared whole.
DIMS, BLOCK, LEAF = 12, 2048, 64
#: Parts of an interval on the way down to blocks, and rows from which the axes are fitted.
FAN, SAMPLE = 16, 10_000
#: Added to distances for rounding, and taken from those that prove a link without comparing.
SLACK, SURE = 1e-9, 1e-6


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, the same at length 1) of the vectors that can have links, length by length: not null, no null or
    non-finite component, not zero."""
    column = column.cast(pa.large_list(pa.float64()))
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size, valid = np.diff(at), column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(size[valid & (size > 0)]):
        rows = np.flatnonzero(valid & (size == n))
        x = values[at[rows][:, None] + np.arange(n)]
        most = np.abs(x).max(axis=1)  # NaN or infinite where a component is
        good = np.isfinite(most) & (most > 0)
        x = x[good]
        u = x / most[good][:, None]
        yield rows[good], x, u / np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]


def axes(sample: np.ndarray, dims: int) -> np.ndarray:
    """Orthonormal leading principal directions; any would do for right results."""
    _, v = np.linalg.eigh(sample.T @ sample)
    return v[:, ::-1][:, :dims]


def turned(u: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Coordinates on the axes and, last, the length of what they leave: distances between them never exceed the vectors' own."""
    y = np.zeros((len(u), DIMS + 1))
    if basis is None:
        basis = np.zeros((u.shape[1], 0))
    y[:, : basis.shape[1]] = u @ basis
    y[:, DIMS] = np.linalg.norm(u - y[:, : basis.shape[1]] @ basis.T, axis=1)
    return y


class Sequence:
    """Unit vectors in grid order, in leaves of so many rows with their boxes and balls."""

    def __init__(self, u: np.ndarray, y: np.ndarray, leaf: int = LEAF):
        self.u, self.starts = u, np.arange(0, len(u), leaf)
        self.lo, self.hi = np.minimum.reduceat(y, self.starts), np.maximum.reduceat(y, self.starts)
        self.ends = np.append(self.starts[1:], len(u))
        self.center = np.add.reduceat(u, self.starts) / (self.ends - self.starts)[:, None]
        away = np.linalg.norm(u - np.repeat(self.center, self.ends - self.starts, axis=0), axis=1)
        self.radius = np.maximum.reduceat(away, self.starts)


def join(a: Sequence, b: Sequence, eps: float, meet: Callable[[int, int, bool], None]) -> None:
    """Recursively joins the intervals of two sequences, or of one with itself, down to pairs of leaves.

    Intervals whose boxes are further apart than eps are skipped. meet(p, q, sure) is called for pairs of leaves;
    sure: their balls lie so close that all of their rows are linked.
    """
    same, todo = a is b, [((0, len(a.starts)), (0, len(b.starts)))]
    while todo:
        (i, j), (p, q) = todo.pop()
        if same and (i, j) == (p, q) and j - i > 1:
            m = (i + j) // 2
            todo += [((i, m), (i, m)), ((i, m), (m, j)), ((m, j), (m, j))]
            continue
        gap = np.maximum(0.0, np.maximum(a.lo[i:j].min(0) - b.hi[p:q].max(0), b.lo[p:q].min(0) - a.hi[i:j].max(0)))
        if gap @ gap > eps * eps:
            continue
        if j - i == 1 and q - p == 1:
            reach = a.radius[i] + b.radius[p]
            far = 0.0 if same and i == p else float(np.linalg.norm(a.center[i] - b.center[p]))
            if far - reach <= eps:
                meet(i, p, far + reach <= eps - SURE)
        elif j - i >= q - p:
            m = (i + j) // 2
            todo += [((i, m), (p, q)), ((m, j), (p, q))]
        else:
            m = (p + q) // 2
            todo += [((i, j), (p, m)), ((i, j), (m, q))]


def links(a: Sequence, b: Sequence, n_a: np.ndarray, n_b: np.ndarray, eps: float, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For each row the rows it is linked with in the other sequence, by their counts, and edges that span the
    components: rows of b come after those of a, unless it is the same sequence."""
    same, shift = a is b, 0 if a is b else len(a.u)
    out_a = np.zeros(len(a.u), np.int64)
    out_b = out_a if same else np.zeros(len(b.u), np.int64)
    parent = np.arange(len(a.u) + (0 if same else len(b.u)))
    edges: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def tie(x: int, y: int) -> None:
        r, s = root(x), root(y)
        if r != s:
            parent[max(r, s)] = min(r, s)
            edges.append((x, y))

    def meet(p: int, q: int, sure: bool) -> None:
        i, j, k, m = a.starts[p], a.ends[p], b.starts[q], b.ends[q]
        own = same and p == q
        if sure:
            out_a[i:j] += n_b[k:m].sum() - (n_a[i:j] if own else 0)
            if not own:
                out_b[k:m] += n_a[i:j].sum()
            for x in range(i, j):
                tie(x, k + shift)
            for y in range(k + 1, m):
                tie(i, y + shift)
            return
        hit = a.u[i:j] @ b.u[k:m].T >= least
        if own:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        out_a[i:j] += hit @ n_b[k:m]
        if not own:
            out_b[k:m] += n_a[i:j] @ hit
        for x, y in np.argwhere(hit):
            if not own or x < y:
                tie(int(i + x), int(k + y + shift))

    join(a, b, eps, meet)
    return out_a, out_b, edges


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """(label, len, p, q), p <= q, of blocks whose boxes are no further apart than eps.

    Blocks are gathered FAN by FAN into wider intervals of the sequence; pairs of intervals are parted again level by
    level, and only those that their boxes don't set apart go on.
    """
    dims = range(DIMS + 1)
    top = blocks.agg(F.max("block")).first()[0] or 0
    levels = [blocks]
    while top >= 1:
        levels.append(materialize(levels[-1].groupBy("label", "len", F.expr(f"block div {FAN}").alias("block")).agg(*(F.min(f"lo{i}").alias(f"lo{i}") for i in dims), *(F.max(f"hi{i}").alias(f"hi{i}") for i in dims))))
        top //= FAN
    pairs = levels[-1].select("label", "len", F.col("block").alias("p"), F.col("block").alias("q"))
    for level in levels[-2::-1]:
        sides = []
        for x in "pq":
            side = level.select(F.col("label").alias(f"label_{x}"), F.col("len").alias(f"len_{x}"), F.expr(f"block div {FAN}").alias(f"up_{x}"), F.col("block").alias(f"new_{x}"), *(F.col(f"{e}{i}").alias(f"{e}{i}{x}") for i in dims for e in ("lo", "hi")))
            sides.append(side)
        for x, side in zip("pq", sides):
            pairs = pairs.join(side, (F.col("label") == F.col(f"label_{x}")) & (F.col("len") == F.col(f"len_{x}")) & (F.col(x) == F.col(f"up_{x}"))).drop(f"label_{x}", f"len_{x}", f"up_{x}")
        gaps = [F.greatest(F.lit(0.0), F.col(f"lo{i}p") - F.col(f"hi{i}q"), F.col(f"lo{i}q") - F.col(f"hi{i}p")) for i in dims]
        pairs = pairs.filter((F.col("new_p") <= F.col("new_q")) & (sum(g * g for g in gaps) <= eps * eps))
        pairs = materialize(pairs.select("label", "len", F.col("new_p").alias("p"), F.col("new_q").alias("q")))
    return pairs


def vector_join(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """id, n_links, component_id, kept for each row of vectors.

    Vectors are linked when their labels are equal and not null, their lengths are equal and their cosine in double
    precision is least or more. Null and zero vectors and those with a null or non-finite component have no links.
    Rows that share an id are vectors of their own in n_links; component_id is the least id that isn't null, a null id
    is the largest and never kept. Other columns of vectors are ignored; an empty table gives no rows.

    Equal vectors of a label are one class with a count. Unit vectors are turned to leading principal axes, fitted
    on a bounded sample, and sorted by label and grid cells of the width of the greatest distance. Intervals of the
    sequence are joined recursively: down to blocks by their boxes alone, before any vector moves; then in each pair
    of blocks that is left, down to leaves. A box holds the axes and the length of what they leave, so its distance is
    a lower bound. Leaves whose balls prove all or none of their links aren't compared. A pair of blocks yields a count
    for each row and edges that span its components, never pairs.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [None] * batch.num_rows, [None] * batch.num_rows
            named = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for at, x, u in usable(batch.column(2)):
                for k, r in enumerate(at):
                    if named[r]:
                        keys[r], units[r] = hashlib.blake2b(x[k].tobytes(), digest_size=16).digest(), u[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["id", "label", "key", "u"])

    label = T.StructField("label", rows.schema["label"].dataType)
    keys = materialize(rows.mapInArrow(keyed, T.StructType([T.StructField("id", T.LongType()), label, T.StructField("key", T.BinaryType()), T.StructField("u", T.BinaryType())])))
    classes = keys.filter("key IS NOT NULL").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("u").alias("u"))
    classes = materialize(classes.withColumns({"cid": F.monotonically_increasing_id(), "len": (F.octet_length("u") / 8).cast("int")}))
    every = max(1, classes.count() // SAMPLE)
    sample: dict[int, list[np.ndarray]] = {}
    for r in classes.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).limit(2 * SAMPLE).select("u", "len").collect():
        sample.setdefault(r["len"], []).append(np.frombuffer(r["u"], np.float64))
    sent = spark.sparkContext.broadcast({n: axes(np.stack(x), min(DIMS, n)) for n, x in sample.items()})

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = np.zeros((batch.num_rows, DIMS + 1))
            units, lens = batch.column(4).to_pylist(), batch.column(3).to_numpy()
            for n in np.unique(lens):
                at = np.flatnonzero(lens == n)
                ys[at] = turned(np.frombuffer(b"".join(units[r] for r in at), np.float64).reshape(len(at), n), sent.value.get(int(n)))
            y = pa.ListArray.from_arrays(pa.array(np.arange(len(ys) + 1) * (DIMS + 1), pa.int32()), pa.array(ys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, y], names=[*batch.schema.names, "y"])

    lead = classes.select("cid", "n", "label", "len", "u")
    points = lead.mapInArrow(located, T.StructType([*lead.schema, T.StructField("y", T.ArrayType(T.DoubleType()))]))
    ordered = running(points, ["label", "len"], [F.transform("y", lambda c: F.floor(c / eps)), F.col("cid")], F.lit(1).cast("long"), "at")
    ordered = materialize(ordered.withColumn("block", F.expr(f"at div {block}")))
    bounds = [f(F.col("y")[i]).alias(f"{e}{i}") for i in range(DIMS + 1) for e, f in (("lo", F.min), ("hi", F.max))]
    pairs = near_blocks(materialize(ordered.groupBy("label", "len", "block").agg(*bounds)), eps)
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("p", "q"))))
    tasks = ordered.select("label", "len", "block", "cid", "u", "n", "at").join(sides, ["label", "len", "block"])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        u = np.frombuffer(b"".join(frame["u"]), np.float64).reshape(len(frame), -1)
        y, n, cid = turned(u, sent.value.get(u.shape[1])), frame["n"].to_numpy(), frame["cid"].to_numpy()
        cut = int((frame["block"] == frame["p"]).sum())
        a = Sequence(u[:cut], y[:cut], leaf)
        b = a if cut == len(u) else Sequence(u[cut:], y[cut:], leaf)
        in_a, in_b, edges = links(a, b, n[:cut], n[:cut] if b is a else n[cut:], eps, least)
        count = in_a if b is a else np.concatenate([in_a, in_b])
        some = np.flatnonzero(count)
        counts = pd.DataFrame({"a": cid[some], "b": cid[some], "n": count[some]})
        return pd.concat([counts, pd.DataFrame([(int(cid[x]), int(cid[y]), 0) for x, y in edges], columns=["a", "b", "n"], dtype=np.int64)])

    found = materialize(tasks.groupBy("label", "len", "p", "q").applyInPandas(compare, "a long, b long, n long"))
    counts = found.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    reach = components(found.filter("a <> b").select("a", "b")).withColumnsRenamed({"id": "cid", "component_id": "root"})
    info = classes.drop("u", "len").join(counts, "cid", "left").join(reach, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least_id = info.groupBy("root").agg(F.min("rep").alias("component"))
    info = info.join(least_id, "root").select("label", "key", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    out = look_up(keys.drop("u"), materialize(info), ["label", "key"], "n")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
