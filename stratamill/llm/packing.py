"""Best-fit packing of token sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamill.llm.common import BROADCAST_ROWS, materialize

PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


#: Words of printable ASCII and of Latin letters that case folding and composition treat one by one.
_LATIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
#: The vocabulary's own pattern of parts of a word, for such words in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017f0-9]+")
#: Characters that stand for the bytes in the vocabulary: printable Latin-1 ones themselves, the others from 256 on.
_SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_STANDS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


#: Pieces and gaps that one partition of a round goes through.
ROWS = 200_000


class Encoder(dict):
    """Ids of words as bytes. Merges never cross white space, so each distinct word is encoded once while it is held.

    Latin words go to the merges directly; all others, and any that may hold a special token, through the whole
    tokenizer.
    """

    held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize

    @classmethod
    def of(cls, path: str) -> Encoder:
        return cls.held.get(path) or cls.held.setdefault(path, cls(path))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if _LATIN.fullmatch(word) and "<|" not in word:
            ids, parts = b"", _PARTS.findall(word.lower())
            for x in parts:
                if len(parts) > 1 and x in self:
                    ids += self[x]
                    continue
                seen = x if x.isascii() else x.encode().decode("latin-1").translate(_STANDS)
                ids += array("I", [t.id for t in self.merge(seen)]).tobytes()
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def encode(self, text: str, words: int) -> bytes:
        if len(self) > words:
            self.clear()
        # these four part words for str.split(), but aren't white space to the tokenizer
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", words: int = 1_500_000) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end id, cut every capacity ids.

    A null or empty text is the end id alone. words: most distinct words whose ids a worker holds.
    """
    last = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "", words) + last
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((r, p, at // 4, len(part) // 4, zlib.crc32(part)))
            r, *rest = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType([docs.schema[id_col], *PIECES]))


def bands(capacity: int) -> list[tuple[int, int]]:
    """(lo, hi]: lengths of which capacity // hi fit in a sequence, the wider the shorter they are."""
    ends = sorted({capacity, *(capacity // k for k in (2, 3, 4, 8, 32))} - {0}, reverse=True)
    return list(zip([*ends[1:], 0], ends))


@dataclass
class Round:
    """What a round leaves: seats (item, gap, offset) of several tables, gaps (gap, width), items that are left
    (item, length, rank by length), their number, and whether one more round with the same gaps could seat any."""

    seats: list[DataFrame]
    gaps: DataFrame
    items: DataFrame
    left: int
    again: bool


def side_by_side(rows: DataFrame, capacity: int) -> DataFrame:
    """(item, gap, offset, rest) of rows (item, length, gap, width, place): the items of a gap one after the other by
    place; rest is the width that is left behind the last of them, null for the others."""
    by_gap = Window.partitionBy("gap")
    before = F.sum("length").over(by_gap.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    last = F.col("place") == F.max("place").over(by_gap)
    return rows.select("item", "gap", (capacity - F.col("width") + F.coalesce(before, F.lit(0))).alias("offset"), F.when(last, F.col("width") - F.sum("length").over(by_gap)).alias("rest"))


def sweep(items: DataFrame, gaps: DataFrame, capacity: int, parts: int) -> Round:
    """Items (item, length) and gaps (gap, width) are range-sorted together, the longest first, gaps before items of
    their width. Each partition goes through its range: an item goes to the successor of its length among the
    partition's gaps, and what is left of that gap is a gap again. Items that found none are carried to the gaps which
    earlier partitions have left, all of which are wide enough: one row for each partition says how many items and
    places there are, and items take places by rank, from the last and narrowest gap on.
    """
    both = gaps.select(F.col("width").alias("size"), F.lit(0).alias("kind"), F.col("gap").alias("id")).union(items.select("length", F.lit(1), "item"))
    order = [F.desc("size"), F.col("kind"), F.col("id")]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State 0: a seat; 1: an item that is left, by rank; 2: a gap and its places; 3: the partition's sums."""
        from pyspark import TaskContext

        part, widths, held, left, shortest = TaskContext.get().partitionId(), 0, [[] for _ in range(capacity + 1)], 0, capacity
        least = None
        names = ["state", "part", "at", "item", "length", "gap", "width"]

        def rows(found: list[tuple[int, ...]]) -> pa.RecordBatch:
            a = np.array(found, np.int64).reshape(-1, 6)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(np.full(len(a), part)), *(pa.array(a[:, c]) for c in range(1, 6))], names=names)

        for batch in batches:
            found = []
            for size, kind, key in zip(*(batch.column(c).to_pylist() for c in range(3))):
                least = size
                if not kind:
                    held[size].append(key)
                    widths |= 1 << size
                    continue
                wide = widths >> size
                if not wide:
                    found.append((1, left, key, size, 0, 0))
                    left, shortest = left + 1, size
                    continue
                width = size + (wide & -wide).bit_length() - 1
                gap = held[width].pop()
                if not held[width]:
                    widths ^= 1 << width
                found.append((0, capacity - width, key, size, gap, width))
                if rest := width - size:
                    held[rest].append(gap)
                    widths |= 1 << rest
            if found:
                yield rows(found)
        if least is None:
            return
        # places for items of later partitions: none is longer than the least size of this one
        first, found = 0, []
        for width in range(capacity, 0, -1):
            for gap in held[width]:
                found.append((2, first, 0, width // least, gap, width))
                first += width // least
        widest = widths.bit_length() - 1 if widths else 0
        yield rows([*found, (3, left, first, shortest, 0, widest)])

    spark = items.sparkSession
    ranged = both.repartitionByRange(parts, *order) if parts > 1 else both.coalesce(1)
    out = materialize(ranged.sortWithinPartitions(*order).mapInArrow(fit, "state long, part long, at long, item long, length long, gap long, width long"))
    ended: list[tuple[int, int, int]] = []
    carried: list[tuple[int, int, int, int, int]] = []
    ranks, left, widest, shortest = [], 0, 0, capacity
    for r in sorted(out.filter("state = 3").collect(), key=lambda r: r["part"]):
        at, mine, places = 0, r["at"], r["item"]
        while at < mine and ended:
            part, first, end = ended.pop()
            many = min(mine - at, end - first)
            carried.append((r["part"], at, many, part, end - many))
            at += many
            if end - many > first:
                ended.append((part, first, end - many))
        if places:
            ended.append((r["part"], 0, places))
        if at < mine:
            ranks.append((r["part"], at, left - at))
            shortest = min(shortest, r["length"])
        left, widest = left + mine - at, max(widest, r["width"])
    rest, open_ = out.filter("state = 1").select("item", "length", "part", "at"), out.filter("state = 2").select("gap", "width", "part", "at", F.col("length").alias("places"))
    ranked = rest.join(F.broadcast(spark.createDataFrame(ranks, "part long, from long, before long")), "part").filter("at >= from")
    found = Round([out.filter("state = 0").select("item", "gap", F.col("at").alias("offset"))], open_.select("gap", "width"), ranked.select("item", "length", (F.col("before") + F.col("at")).alias("rank")), left, widest >= shortest)
    if carried:
        segments = F.broadcast(spark.createDataFrame(carried, "part long, first long, many long, to long, place long"))
        seated = rest.join(segments, "part").filter("at >= first AND at < first + many")
        seated = seated.select("item", "length", F.col("to").alias("part"), (F.col("place") + F.col("at") - F.col("first")).alias("place"))
        taken = open_.join(segments.select(F.col("to").alias("part"), F.col("place").alias("start"), "many"), "part").filter("at < start + many AND at + places > start")
        taken = taken.select("gap", "width", "part", F.explode(F.sequence(F.greatest("at", "start"), F.least(F.col("at") + F.col("places"), F.col("start") + F.col("many")) - 1)).alias("place"))
        hint = F.broadcast if sum(c[2] for c in carried) <= BROADCAST_ROWS else lambda df: df
        met = materialize(side_by_side(taken.join(hint(seated), ["part", "place"]), capacity))
        narrower = met.filter("rest IS NOT NULL").select("gap", F.col("rest").alias("width"))
        found.seats.append(met.select("item", "gap", "offset"))
        found.gaps = found.gaps.join(hint(narrower.select("gap")), "gap", "left_anti").union(narrower.filter("width > 0"))
    return found


def pack(parts: DataFrame, capacity: int = 2048, id_col: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, start, length, ids_crc32); repeated rows are packed each.

    Bands of lengths, the longest first, go through rounds of sweep() until none of a band's pieces fits a gap; then
    new sequences are opened for those that are left, all at once: runs by rank of as many pieces as fit for sure share
    one. A partition of a round has about so many rows, so rounds with few are one task's. Where shorter pieces of the band may fill such sequences up, first only as many are opened as the room that
    is needed. The driver holds a row for each partition and the numbers of a round; what a round finds is written, so
    a lost executor costs the present one.
    """
    spark = parts.sparkSession
    parts = materialize(parts.withColumn("_item", F.monotonically_increasing_id()))
    lengths = parts.select(F.col("_item").alias("item"), "length")
    counts = lengths.agg(*(F.count_if((F.col("length") > lo) & (F.col("length") <= hi)) for lo, hi in bands(capacity))).first()
    gaps, seats, opened, unions = spark.createDataFrame([], "gap long, width long"), [], 0, 0
    for (lo, hi), n in zip(bands(capacity), counts):
        each, items, openings = capacity // hi, lengths.filter((F.col("length") > lo) & (F.col("length") <= hi)), 0
        while n:
            if unions > 4:
                gaps, unions = materialize(gaps), 0
            now = sweep(items, gaps.filter(F.col("width") > lo), capacity, -(-(n + opened) // rows))
            seats += now.seats
            gaps, unions = now.gaps.union(gaps.filter(F.col("width") <= lo)), unions + 1
            if now.left and now.again and now.left < n:
                items, n = now.items.select("item", "length"), now.left
                continue
            n = now.left
            if not n:
                break
            # no more than each fit where all lengths are above capacity / (each + 1)
            new = -(-n // each) if openings or lo >= capacity // (each + 1) else -(-now.items.agg(F.sum("length")).first()[0] // capacity)
            first = now.items.filter(F.col("rank") < new * each).select("item", "length", (opened + F.expr(f"rank div {each}")).alias("gap"), F.lit(capacity).cast("long").alias("width"), F.col("rank").alias("place"))
            if each > 1:
                met = materialize(side_by_side(first, capacity))
            else:
                met = first.select("item", "gap", F.lit(0).cast("long").alias("offset"), (F.col("width") - F.col("length")).alias("rest"))
            seats.append(met.select("item", "gap", "offset"))
            gaps, unions = gaps.union(met.filter("rest > 0").select("gap", F.col("rest").alias("width"))), unions + 1
            items, n, opened, openings = now.items.filter(F.col("rank") >= new * each).select("item", "length"), max(0, n - new * each), opened + new, openings + 1
    where = spark.createDataFrame([], "item long, gap long, offset long")
    for x in seats:
        where = where.union(x)
    found = parts.join(where, F.col("_item") == F.col("item"))
    return found.select(*(c for c in parts.columns if c != "_item"), F.col("gap").alias("sequence_id"), "offset")
