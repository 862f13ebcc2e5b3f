"""Sharding by jump consistent hashing.

Every row's shard follows from its key and the number of shards alone, without a ring table. Growing from n to
n+1 shards moves about 1/(n+1) of the keys, all of them into the new shard. Slots number the rows of a shard
without gaps; they are dealt in two levels (rows counted by physical partition and shard, then numbered within),
so no task holds a whole shard, whatever the keys are.

Defined results: a null key is a key like any other; a null text has size 8 and checksum 0; equal keys share a
shard; repeated rows keep a slot each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, durable, ship, whole_text

SHARDS = 24
ROW_OVERHEAD = 8


def jump_hash(keys: np.ndarray, *counts: int) -> list[np.ndarray]:
    """Shards of 64-bit keys for each number of shards in ``counts``, from one walk over the jumps."""
    state = np.ascontiguousarray(keys).view(np.uint64).copy()
    found = [np.zeros(len(state), np.int32) for _ in counts]
    bucket, todo = np.zeros(len(state), np.int64), np.arange(len(state))
    most = max(counts)
    while len(todo):
        for out, n in zip(found, counts, strict=True):
            fits = bucket < n
            out[todo[fits]] = bucket[fits]
        with np.errstate(over="ignore"):
            state = state * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0)
        bucket = ((bucket + 1) * scale).astype(np.int64)
        going = bucket < most
        state, bucket, todo = state[going], bucket[going], todo[going]
    return found


def with_shards(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (the shard with one shard more) to every row, by ``key``."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    ship(df.sparkSession)

    @F.pandas_udf("struct<shard:int,grown_shard:int>")
    def place(keys: pd.Series) -> pd.DataFrame:
        now, grown = jump_hash(keys.to_numpy(np.int64), n_shards, n_shards + 1)
        return pd.DataFrame({"shard": now, "grown_shard": grown})

    return df.withColumn("_to", place(F.xxhash64(F.col(key)))).withColumns({"shard": F.col("_to.shard"), "grown_shard": F.col("_to.grown_shard")}).drop("_to")


def with_slots(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each ``shard``."""
    placed = durable(df).withColumn("_part", F.spark_partition_id())
    upto = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part", "shard").count().select("_part", "shard", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part", "shard").orderBy(*order)
    return placed.withColumn("_rank", F.row_number().over(own)).join(starts, ["_part", "shard"]).withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_part", "_start", "_rank")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    text = whole_text()
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return with_slots(with_shards(rows, "doc_id", n_shards), ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


QUERIES = {"op7_jump_shards": op7_jump_shards}
ORACLE_SQL: dict[str, str] = {}
