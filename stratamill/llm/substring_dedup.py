"""Substring dedup by suffix trees over groups of suffixes that a variable-length prefix sets apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm import words as W
from stratamill.llm.common import look_up, materialize, null_safe

HEAD = "n_words long, whole_sha256 string"
#: Words of the grams among which a window's anchor is chosen.
GRAM = 6
#: Words of a suffix that order it, BITS of each one's hash, as many in a long as fit.
LEVELS, BITS = 12, 16
EACH = 64 // BITS
KEYS = [f"w{i}" for i in range(LEVELS // EACH)]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
#: States of an anchor in a document: not met yet, met in another one, a row that stands for two that met.
OPEN, HIT, SEEN = 0, 1, 2


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each word the least hash among the grams of the window that starts there; equal windows have equal anchors."""
    k = min(GRAM, window)
    wide = window - k + 1
    g, _ = W.grams(h, np.array([0, len(h)]), k)
    out, have = g, 1
    while have < wide:
        step = min(have, wide - have)
        out = np.concatenate([np.minimum(out[:-step], out[step:]), out[-step:]]) if len(out) > step else out
        have += step
    return out


def tagged(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys of (hash, row of the batch)."""
    return h ^ W.mix(doc.astype(np.uint64) + np.uint64(1))


def ordering(h: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """The first words, LEVELS at most, of the suffixes that start at at, as one column for each EACH of them.

    Equal prefixes of words are equal prefixes of the columns' bits, so suffixes sorted by the columns stand as a suffix
    tree has them: those that share a prefix are next to each other.
    """
    letters, out = h >> np.uint64(64 - BITS), []
    for k in range(0, LEVELS, EACH):
        column = np.zeros(len(at), np.uint64)
        for i in range(k, k + EACH):
            column = (column << np.uint64(BITS)) | (letters[at + i] if i < window else np.uint64(0))
        out.append(column)
    return out


def depths(columns: list[np.ndarray], path: np.ndarray, window: int) -> np.ndarray:
    """How many words each suffix shares with the one before it: the depth of the inner node at which the two part.

    LEVELS at most for suffixes that are told apart by their paths alone; window for those of one path; 0 for the first.
    """
    out, whole = np.zeros(len(path), np.int64), np.ones(max(len(path) - 1, 0), bool)
    for column in columns:
        apart = column.view(np.uint64)[1:] ^ column.view(np.uint64)[:-1]
        for i in range(1, EACH + 1):
            out[1:] += whole & (apart >> np.uint64(64 - BITS * i) == 0)
        whole &= apart == 0
    out[1:] = np.where(whole & (path[1:] == path[:-1]), window, np.minimum(out[1:], window - 1))
    return out


def heads(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [t.split() for t in batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(s)).hexdigest() for s in split])], names=[id_col, "n_words", "whole_sha256"])

    return docs.select(id_col, text_col).mapInArrow(head, f"{id_col} long, {HEAD}")


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 for each row of docs; see kept_texts() for the texts themselves."""
    return _dedup(docs, window, id_col, text_col, support)[0]


def kept_texts(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """(id, whole_sha256, n_removed, kept_sha256, kept, spans) of the rows that lose words by windows; kept is what stays, spans the runs of words that go."""
    return _dedup(docs, window, id_col, text_col, support)[1]


def _dedup(docs: DataFrame, window: int, id_col: str, text_col: str, support: float) -> tuple[DataFrame, DataFrame]:
    """Removes each word covered by a window whose words also start in a document with a smaller id.

    Windows are judged on the input. Ids are integers; rows with a null id keep all their words and take none from
    others, and rows that share an id don't take from each other. A null text has no words.

    1. Rows with the same words as one with a smaller id lose all their words if a window fits in. Of digests that hold
       over support of all rows (1 / support at most) the first ids are broadcast, so copies of a very frequent text
       go no further.
    2. The suffix that starts at a word can only repeat if the least hash among its window's grams, which equal
       windows share, occurs in two documents; about a quarter of the positions have a hash of their own to compare.
       Hashes that meet within a batch of documents are settled there and send one row, so frequent passages make no
       large groups; the others meet in a pass over sorted rows that holds one row.
    3. The suffixes that are left, cut at the window's length, are range-sorted by their words in order (ordering()),
       then path (a hash of the window), then id. The borders that the sort finds are prefixes of as many words as it
       takes to make groups of like size: a rare word sets a group apart alone, a frequent phrase is split by what
       follows it, and a path that holds very many documents is cut among its documents. In a group the suffix tree is
       given by the depths at which neighbours part (depths()); it is walked batch by batch, so a group needs no more
       memory than a batch. Its inner nodes as deep as a window are the repeats: below one, every document but the
       first loses the window. Nodes of no such depth are passed over. Nodes that cross a border are joined by one row
       for each group. Overlapping windows of a document make one repeat of any length (spans of kept_texts()).
    4. The windows found go back to their documents, which alone are read again.
    """
    spark = docs.sparkSession
    head = materialize(heads(docs, id_col, text_col))
    fits = head.filter(F.col("n_words") >= window).select(id_col, "whole_sha256")
    firsts = materialize(fits.groupBy("whole_sha256").agg(F.min(id_col).alias("_first"), F.max(id_col).alias("_last"), F.count("*").alias("_n")))
    total = firsts.agg(F.sum("_n")).first()[0] or 0
    firsts = firsts.filter("_first < _last").drop("_last")
    heavy = {r[0]: r[1] for r in firsts.filter(F.col("_n") > support * total).collect()}
    copies = look_up(fits, firsts, ["whole_sha256"], "_n").filter(F.col(id_col) > F.col("_first"))
    copies = materialize(copies.select(id_col, "whole_sha256").distinct())
    # ids of which every row is a copy; rows that share an id may have different words
    others = head.join(copies.select(id_col).distinct(), id_col, "left_semi").join(copies, [id_col, "whole_sha256"], "left_anti")
    gone = copies.select(id_col).distinct().join(others.select(id_col).distinct(), id_col, "left_anti")
    sent = spark.sparkContext.broadcast(heavy)

    def emit(ids: pa.Array, rows: np.ndarray, *columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *(pa.array(c.view(np.int64)) for c in columns)], names=names)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = sent.value
        for batch in batches:
            for i, j, raw, at in W.chunks(batch.column(1)):
                ids = batch.column(0).slice(i, j - i)
                drop = np.zeros(j - i, bool)
                if keep:
                    for r, (key, a, b) in enumerate(zip(ids.to_pylist(), at[:-1], at[1:])):
                        first = keep.get(hashlib.sha256(b" ".join(raw[a:b].tobytes().split())).hexdigest())
                        drop[r] = first is not None and key != first
                drop |= ids.is_null().to_numpy(zero_copy_only=False)
                h, _, _, bounds = W.words(raw, at)
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                _, ok = W.grams(h, bounds, window)
                ok &= ~drop[doc]
                a, doc = anchors(h, window)[ok], doc[ok]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                a, doc = a[new], doc[new]
                order = np.lexsort((a, doc))
                a, doc = a[order], doc[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                a, doc = a[new], doc[new]
                # hashes of two documents of this batch: their rows are hits, and one of them stands for all elsewhere
                order = np.argsort(a, kind="stable")
                starts = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(a) else np.zeros(0, np.int64)
                many = np.diff(np.append(starts, len(a))) > 1
                state = np.full(len(a), OPEN, np.int64)
                state[order] = np.where(np.repeat(many, np.diff(np.append(starts, len(a)))), HIT, OPEN)
                one = order[starts[many]]
                yield emit(ids, np.concatenate([doc, doc[one]]), np.concatenate([a, a[one]]), np.concatenate([state, np.full(len(one), SEEN)]), names=[id_col, "h", "state"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, id, state) come by h and id: the open ones of a hash that two ids have, or that was seen twice."""
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            h, ids, state = (np.concatenate([x, batch.column(c).to_numpy()]) for c, x in enumerate(held))
            if not len(h):
                continue
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(starts, len(h)))
            hit = (np.maximum.reduceat(state, starts) == SEEN) | (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts))
            out = np.repeat(hit, size) & (state == OPEN)
            # the last hash may go on: what is known of it is held in a row
            held = [h[-1:], ids[-1:], np.full(1, SEEN if hit[-1] else OPEN)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(h[out])], names=[id_col, "h"])

    marks = materialize(docs.select(id_col, text_col).mapInArrow(anchored, f"{id_col} long, h long, state long"))
    met = marks.filter(F.col("state") != HIT).select("h", id_col, "state").repartition("h").sortWithinPartitions("h", id_col).mapInArrow(meet, f"{id_col} long, h long")
    hits = marks.filter(F.col("state") == HIT).select(id_col, "h").union(met).join(gone, id_col, "left_anti")
    hits = materialize(hits.groupBy(id_col).agg(F.collect_set("h").alias("_hits")))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in W.chunks(batch.column(1)):
                ids, lists = batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i)
                h, _, _, bounds = W.words(raw, at)
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                path, ok = W.grams(h, bounds, window)
                hit = tagged(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(j - i), np.asarray(lists.value_lengths().fill_null(0))))
                k = np.flatnonzero(ok)
                k = k[np.isin(tagged(anchors(h, window)[k], doc[k]), hit)]
                order = k[np.lexsort((path[k], doc[k]))]
                new = np.ones(len(order), bool)
                new[1:] = (path[order][1:] != path[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                order = order[new]
                yield emit(ids, doc[order], *ordering(h, order, window), path[order], names=[id_col, *KEYS, "path"])

    with_hits = docs.select(id_col, text_col).join(hits, id_col)
    longs = ", ".join(f"{k} long" for k in KEYS)
    tree = with_hits.select(id_col, text_col, "_hits").mapInArrow(suffixes, f"{id_col} long, {longs}, path long")
    by = [*KEYS, "path", id_col]
    tree = tree.repartitionByRange(*by).sortWithinPartitions(*by).select(*KEYS, "path", F.col(id_col).alias("id"))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State 0: this document loses this window; 1: the group's first row; 2: its last node with the least id."""
        from pyspark import TaskContext

        group, names = TaskContext.get().partitionId(), ["group", "state", "path", "id"]
        last, least = None, None

        def rows(state: int, path: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), x)) for x in (group, state)] + [pa.array(path), pa.array(ids)], names=names)

        for batch in batches:
            *columns, path, ids = (batch.column(c).to_numpy() for c in range(len(KEYS) + 2))
            if not len(ids):
                continue
            if last is None:
                yield rows(1, path[:1], ids[:1])
                last = [c[:1] for c in (*columns, path)]
            *columns, path = (np.concatenate([x, c]) for x, c in zip(last, (*columns, path)))
            deep = depths(columns, path, window)[1:] >= window
            starts = np.flatnonzero(np.append(True, ~deep[1:]))
            first = ids[starts].copy()
            if deep[0] and least is not None:
                first[0] = least
            lost = ids > np.repeat(first, np.diff(np.append(starts, len(ids))))
            last, least = [c[-1:] for c in (*columns, path)], first[-1]
            yield rows(0, path[1:][lost], ids[lost])
        if last is not None:
            yield rows(2, last[-1], np.array([least]))

    found = materialize(tree.mapInArrow(subtrees, "group long, state long, path long, id long"))
    lost = found.filter("state = 0").select(F.col("id").alias(id_col), "path")
    borders, ended = [], {}
    for r in found.filter("state > 0").orderBy("group", "state").collect():
        if r.state == 1 and (least := ended.get(r.path)) is not None and least < r.id:
            borders.append((r.id, r.path))
        if r.state == 2:
            ended = {r.path: min(r.id, ended.get(r.path, r.id))}
    if borders:
        lost = lost.union(spark.createDataFrame(borders, f"{id_col} long, path long"))
    lost = materialize(lost.groupBy(id_col).agg(F.collect_set("path").alias("_lost")))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in W.chunks(batch.column(1)):
                lists = batch.column(2).slice(i, j - i)
                h, first, end, bounds = W.words(raw, at)
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                path, ok = W.grams(h, bounds, window)
                gone = tagged(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(j - i), np.asarray(lists.value_lengths().fill_null(0))))
                hit = ok & np.isin(tagged(path, doc), gone)
                depth = np.zeros(len(h) + window + 1, np.int64)
                depth[: len(h)] += hit
                depth[window : window + len(h)] -= hit
                out = np.cumsum(depth)[: len(h)] > 0
                rows = []
                for r in range(j - i):
                    a, b = bounds[r], bounds[r + 1]
                    text = raw[at[r] : at[r + 1]].tobytes()
                    split = text.split()
                    left = b" ".join([w for w, o in zip(split, out[a:b].tolist()) if not o])
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], out[a:b], [False]]).astype(np.int8)))
                    spans = [{"start": x, "length": y - x} for x, y in edge.reshape(-1, 2).tolist()]
                    rows.append((hashlib.sha256(b" ".join(split)).hexdigest(), int(out[a:b].sum()), hashlib.sha256(left).hexdigest(), left.decode(), spans))
                *flat, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, flat), pa.array(spans, SPANS)], names=[id_col, "whole_sha256", "n_removed", "kept_sha256", "kept", "spans"])

    with_lost = docs.select(id_col, text_col).join(lost, id_col)
    texts = with_lost.select(id_col, text_col, "_lost").mapInArrow(rest, f"{id_col} long, whole_sha256 string, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,length:long>>")
    part = materialize(texts.drop("kept", "spans").distinct())
    out = null_safe(head, part, [id_col, "whole_sha256"], "left")
    out = null_safe(out, copies.withColumn("_copy", F.lit(True)), [id_col, "whole_sha256"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    copy = F.col("_copy").isNotNull()
    out = out.select(id_col, "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"), F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"))
    return out, texts
