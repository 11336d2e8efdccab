"""N-gram Jaccard self-join of documents by a grouped prefix join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm import words as W
from stratamill.llm.common import components, look_up, materialize, running

#: Counters of the shingle sketch (2 bytes each), whatever the corpus; and the slices in which they are summed.
SKETCH, SLICES = 1 << 20, 16
#: A prefix token shared by more groups than this goes by star instead of by pairs.
PAIRS = 12
#: Shingles of a verification block; a document counts as LEAST at least.
BLOCK, LEAST = 1_000_000, 1_000


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles): all words as one where there are fewer, none without words."""
    for i, j, raw, at in W.chunks(column):
        h, _, _, bounds = W.words(raw, at, fold=True)
        g, _ = W.grams(h, bounds, k)
        for r in range(j - i):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= k:
                yield i + r, np.unique(g[a : b - k + 1])
            else:
                yield i + r, W.grams(h[a:b], np.array([0, b - a]), int(b - a))[0][:1] if b > a else np.zeros(0, np.uint64)


def sketch(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many documents have a shingle of each of SKETCH hash classes, up to 65535: one size for any corpus."""
    width = SKETCH // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            held = [np.zeros(0, np.int64)]
            for _, s in shingle_sets(batch.column(0), k):
                held.append((s >> np.uint64(44)).astype(np.int64))
            total += np.bincount(np.concatenate(held), minlength=SKETCH)
        part = np.minimum(total, 65535).astype("<u2")
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES)), pa.array([part[i * width : (i + 1) * width].tobytes() for i in range(SLICES)])], names=["slice", "counts"])

    def add(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, np.int64)
        for frame in parts:
            for c in frame["counts"]:
                total += np.frombuffer(c, "<u2")
        yield pd.DataFrame({"slice": [key[0]], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})

    parts = docs.select(text_col).mapInArrow(count, "slice long, counts binary")
    out = np.zeros(SKETCH, np.uint16)
    for r in parts.groupBy("slice").applyInPandas(add, "slice long, counts binary").collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], "<u2")
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a symmetric matrix."""
    n, out = len(linked), []
    open_ = linked.any(axis=1)
    for s in range(n):
        if not open_[s]:
            continue
        open_[s], todo = False, [s]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(linked[x] & open_)
            open_[near] = False
            out += [(x, int(y)) for y in near]
            todo += near.tolist()
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Hashes in few of the sets are counted pair by pair, those in many by a matrix product."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    df = np.diff(np.append(starts, len(flat)))
    out = np.zeros(n * n, np.int64)
    for d in range(2, 17):
        at = starts[df == d]
        if len(at):
            own = owner[at[:, None] + np.arange(d)]
            for i in range(d):
                for j in range(i + 1, d):
                    out += np.bincount(own[:, i] * n + own[:, j], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    many = np.flatnonzero(df > 16)
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        has = np.zeros((n, len(part)), np.float32)
        for c, m in enumerate(part):
            has[owner[starts[m] : starts[m] + df[m]], c] = 1
        out += np.rint(has @ has.T).astype(np.int64)
    return out


def parity(s: np.ndarray) -> bytes:
    """Bitmap with a bit for each class of hashes, by their low bits, that holds an odd number of them: at least a bit a hash."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as size bits in 64-bit words: halves are added until it is as short."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) * 64 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets, by rising size n, can be linked: a bit that differs is a shingle that only one of them has."""
    m = len(n)
    out = np.zeros((m, m), bool)
    ends = np.searchsorted(n, n * 100 // percent, "right")
    sizes = np.array([len(b) * 8 for b in bits])
    for size in np.unique(sizes):
        first, after = np.searchsorted(sizes, [size, size + 1])
        held = np.stack([folded(b, size) for b in bits[first : ends[after - 1]]])
        for i in range(first, after):
            total = n[i] + n[i + 1 : ends[i]]
            differ = np.bitwise_count(held[i + 1 - first : ends[i] - first] ^ held[i - first]).sum(axis=1, dtype=np.int64)
            out[i, i + 1 : ends[i]] = (total - differ) // 2 * (100 + percent) >= percent * total
    return out | out.T


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row of docs.

    A document's set is its distinct k-word shingles, A-Z in lower case; with fewer words all of them are one
    shingle; a null or blank text has none and is linked with nothing. Documents are linked when
    100 * intersection >= percent * union, and component_id is the least id that links reach; a null id is the
    largest. Rows that share an id, or have none, are documents of their own. Other columns are ignored; an empty
    table gives no rows.

    1. Documents with equal sets are one class, and classes with equal prefixes and sizes one group. A prefix is the
       first n - ceil(percent n / 100) + 1 shingles, by a sketch's log count of documents and then by hash: linked
       documents share one, and frequent shingles stay out of prefixes.
    2. Groups that meet at a prefix shingle are paired where it is in few groups, and a pair is kept only if the
       shingles shared allow the overlap asked for. Where a shingle is in many groups, they join the star of the
       least, without pairs.
    3. Groups of several classes, kept pairs and stars are expanded to classes, in blocks of bounded size. There,
       bitmaps of a bit a shingle bound the overlaps, and classes without a possible partner leave.
    4. What is left is verified on whole sets, each cluster of a block once however many blocks have it; only edges
       that span its components leave it.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.log2(sketch(docs, text_col, k).astype(float) + 1).astype(np.uint64))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            n, key, bits, prefix = [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                first = len(s) + (percent * len(s) // -100) + 1 if len(s) else 0
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bits.append(parity(s) if len(s) else b"")
                order = (rank[(s >> np.uint64(44)).astype(np.int64)] << np.uint64(59)) | (s >> np.uint64(5))
                prefix.append(s[np.argsort(order, kind="stable")[:first]].view(np.int64))
            at = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bits, pa.binary()), lists], names=["doc", "row", "n_shingles", "set_key", "bits", "prefix"])

    # a number for an id and its text, by which texts are found again
    own = F.xxhash64(id_col, text_col).alias("row")
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), own).mapInArrow(prefixes, "doc long, row long, n_shingles long, set_key binary, bits binary, prefix array<long>"))
    classes = rows.filter("n_shingles > 0").groupBy("n_shingles", "set_key").agg(F.min("doc").alias("rep"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))
    lead = materialize(classes.select("id", F.col("n_shingles").alias("n"), "bits", "prefix", F.sha2(F.array_join(F.col("prefix").cast("array<string>"), ","), 256).alias("group_key")))
    groups = lead.groupBy("n", "group_key").agg(F.min("id").alias("gid"), F.count("*").alias("members"))
    members = materialize(lead.select("id", "n", "bits", "group_key").join(groups, ["n", "group_key"]).select("gid", "id", "n", "bits", "members"))
    tokens = lead.join(members.filter("id = gid").select("id"), "id", "left_semi").select(F.explode("prefix").alias("token"), F.col("id").alias("gid"), "n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by token and then group. Yields pairs (star false) and stars of tokens; holds PAIRS + 1 rows at most."""
        token, held, leader = None, [], None

        def out(rows, star):
            a = np.array(rows, np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(a[:, c]) for c in range(4)] + [pa.array(np.full(len(a), star))], names=["a", "b", "n_a", "n_b", "star"])

        for batch in batches:
            pairs, stars = [], []
            t, g, n = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else []
            for a, b in zip(cuts, [*cuts[1:], len(t)]):
                if t[a] != token:
                    pairs += close(held, leader, percent)
                    token, held, leader = t[a], [], None
                new = list(zip(g[a:b].tolist(), n[a:b].tolist()))
                if leader is None and len(held) + len(new) > PAIRS:
                    leader = held[0] if held else new[0]
                    stars += [(leader[0], x, leader[1], m) for x, m in held]
                    held = []
                if leader is None:
                    held += new
                else:
                    stars += [(leader[0], x, leader[1], m) for x, m in new]
            if pairs:
                yield out(pairs, False)
            if stars:
                yield out(stars, True)
        if pairs := close(held, leader, percent):
            yield out(pairs, False)

    met = tokens.repartition("token").sortWithinPartitions("token", "gid").mapInArrow(meet, "a long, b long, n_a long, n_b long, star boolean")
    met = materialize(met.groupBy("star", "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")))
    rest = F.greatest(*(F.ceil(F.col(c) * percent / 100) - 1 for c in ("n_a", "n_b")))
    enough = (F.col("shared") + rest) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = met.filter("NOT star").filter(enough).select(F.col("a").alias("unit"), F.col("b").alias("gid"))
    stars = met.filter("star").select(F.col("a").alias("unit"), F.col("b").alias("gid"))
    units = pairs.union(pairs.select("unit", F.col("unit").alias("gid"))).union(stars)
    units = units.union(members.filter("members > 1 AND id = gid").select(F.col("gid").alias("unit"), "gid")).distinct()
    units = materialize(units.join(members.select("gid", "id", "n", "bits"), "gid").select("unit", "id", "n", "bits"))
    units = running(units, ["unit"], ["n", "id"], F.greatest("n", F.lit(LEAST)), "_c").select("unit", "id", "n", "bits", F.floor(F.col("_c") / BLOCK).alias("block"))
    units = materialize(units)
    blocks = materialize(units.groupBy("unit", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    other = blocks.select("unit", F.col("block").alias("block_b"), F.col("lo").alias("lo_b"))
    both = blocks.join(other, "unit").filter((F.col("block") <= F.col("block_b")) & (100 * F.col("hi") >= percent * F.col("lo_b"))).select("unit", F.col("block").alias("p"), F.col("block_b").alias("q"))
    sides = both.withColumn("block", F.explode(F.array_distinct(F.array("p", "q"))))
    tasks = units.join(sides, ["unit", "block"]).select("unit", "p", "q", "id", "n", "bits")

    def clusters(frame: pd.DataFrame) -> pd.DataFrame:
        """The classes of a block that may have a partner there, by the cluster they may lie in."""
        frame = frame.sort_values("n", kind="stable")
        near = forest(may_link(frame["n"].to_numpy(), frame["bits"].tolist(), percent))
        ids, lies = frame["id"].to_numpy(), {}
        for x, y in near:  # a cluster's edges follow each other, each from a node met before
            lies.setdefault(x, [x])
            lies[x].append(y)
            lies[y] = lies[x]
        out = []
        for c in {id(c): c for c in lies.values()}.values():
            own = np.sort(ids[c])
            key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            out += [(key, int(x)) for x in own]
        return pd.DataFrame(out, columns=["cluster", "id"]).astype({"id": np.int64})

    left = materialize(tasks.groupBy("unit", "p", "q").applyInPandas(clusters, "cluster binary, id long").distinct())

    # texts are shorter than their sets, so they are what is sent to the clusters
    texts = docs.select(own, F.col(text_col).alias("text"))
    asked = left.join(classes.select("id", "row"), "id")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("id")  # equal rows have one number
        ids = frame["id"].to_numpy()
        sets = [s for _, s in shingle_sets(pa.array(frame["text"], pa.string()), k)]
        common, n = overlaps(sets), np.array([len(s) for s in sets])
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        np.fill_diagonal(linked, False)
        return pd.DataFrame([(int(ids[x]), int(ids[y])) for x, y in forest(linked)], columns=["a", "b"], dtype=np.int64)

    edges = asked.join(texts, "row").groupBy("cluster").applyInPandas(verify, "a long, b long")
    reach = components(edges)
    info = classes.select("id", "n_shingles", "set_key", "rep", "copies").join(reach, "id", "left").withColumn("root", F.coalesce("component_id", "id"))
    least = info.groupBy("root").agg(F.min("rep").alias("component"))
    info = materialize(info.join(least, "root").select("n_shingles", "set_key", "copies", "component"))
    out = look_up(rows.select("doc", "n_shingles", "set_key"), info, ["n_shingles", "set_key"], "copies")
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"))


def close(held: list[tuple[int, int]], leader, percent: int) -> list[tuple[int, int, int, int]]:
    """All pairs of the few groups of a token whose sizes allow a link."""
    if leader is not None or len(held) < 2:
        return []
    return [(a, b, n, m) for i, (a, n) in enumerate(held) for b, m in held[i + 1 :] if 100 * min(n, m) >= percent * max(n, m)]
