"""Shards by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm.common import running


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by the generator's jumps; all keys advance together until each has passed the end."""
    key = keys.astype(np.uint64).copy()
    here, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while (live := ahead < shards).any():
        here[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((here[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(float) + 1))).astype(np.int64)
    return here


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    The id and the number of shards alone decide the shard (law `key`): no ring or table, and with one shard more a
    row either stays or goes into the new one (grown_shard). Rows with a null id go together, by the hash of null.
    size is the text's UTF-8 bytes (null: none) plus overhead. slot numbers a shard's rows from 0 by id, by
    partition sums, so that no shard has to be sorted in one task. Rows that share an id lie next to each other.
    """

    @F.pandas_udf("struct<shard: int, grown_shard: int>")
    def dealt(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            keys = s.to_numpy().astype(np.int64).view(np.uint64)
            yield pd.DataFrame({"shard": jump(keys, shards).astype(np.int32), "grown_shard": jump(keys, shards + 1).astype(np.int32)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), dealt(F.xxhash64(id_col)).alias("_d"))
    narrow = narrow.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "_d.shard", "_d.grown_shard")
    return running(narrow, ["shard"], [F.col(id_col), F.col("text_crc32")], F.lit(1).cast("long"), "slot")
