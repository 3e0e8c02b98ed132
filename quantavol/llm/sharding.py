"""Jump consistent hashing: stable keys to shards without a ring table.

A key's shard depends on the key and the number of shards alone. With one more shard, only the
rows that go into it move, about 1 / (n + 1) of all. (Lamping and Veach, 2014.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.llm._common import Stage, dense_rank, need

#: Fixed values of the published algorithm: its generator's multiplier, and the bits it draws.
MULTIPLIER = 2862933555777941757
DRAW_BITS = 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 .. shards - 1 of 64-bit keys; at most `shards` rounds, as every round raises the shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), dtype=np.int64)
    at = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = at[live]
            key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            draw = ((key[live] >> np.uint64(64 - DRAW_BITS)) + np.uint64(1)).astype(np.float64)
            at[live] = np.floor((out[live] + 1) * (float(1 << DRAW_BITS) / draw)).astype(np.int64)
            live = live[at[live] < shards]
    return out


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key column of any type; a null key has one defined shard, like any value."""

    @F.pandas_udf("int")
    def of(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return of(F.xxhash64(key))


def shard(df: DataFrame, key: str, shards: int, grow_by: int = 1) -> DataFrame:
    """Adds `shard` and `grown_shard` (with grow_by shards more); other columns stay as they are."""
    return df.withColumn("shard", jump_shard(F.col(key), shards)).withColumn("grown_shard", jump_shard(F.col(key), shards + grow_by))


def place_documents(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard, size, checksum and slot of every document.

    Null texts have size 1 and the checksum of no bytes. Documents of equal doc_id get one shard
    and slots of their own. Equal texts under different ids may go to different shards: the law is
    `key`, so one large group of copies doesn't fill a shard. The text is read once, for its length
    and checksum; only narrow rows are shuffled. Slots follow (shard, doc_id, checksum).
    """
    stage = Stage(spark, "shards")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = need(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = stage.table(shard(narrow, "doc_id", shards), "placed")
    ranked = dense_rank(stage, placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", "ranked")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
