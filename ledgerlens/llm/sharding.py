"""Jump consistent hashing: stable keys to shards without a ring table.

``shard_rows`` keeps the key, the size and the checksum of a text with its shard;
``write_shards`` writes whole rows into one folder per shard.

Defined cases: a null key hashes as a fixed value, so such rows share a shard; a
key that is not a whole number is hashed with XXH64 first; a null text has no bytes
(size 16, checksum 0); repeated rows get slots of their own; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import staged, worker_imports

ROW_OVERHEAD = 16
#: Rows that are numbered by one window.
ROWS_PER_RUN = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key (Lamping and Veach); all keys step together."""
    key = keys.astype(np.uint64)
    last = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.ones(len(key), bool)
    while live.any():
        last[live] = ahead[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = np.floor((last[live] + 1) * (2147483648.0 / step)).astype(np.int64)
        live = ahead < shards
    return last.astype(np.int32)


def whole_key(df: DataFrame, key: str) -> Column:
    kind = dict(df.dtypes)[key]
    column = F.col(f"`{key}`")
    number = column.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(column)
    return F.coalesce(number, F.lit(0x5EED).cast("bigint"))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a whole-number key as a column expression."""
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards))

    return jump(key)


def shard_rows(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, grown_shard (with one shard more) and slot.

    Slots number the rows of a shard from 0 without gaps, by runs of keys: rows are counted by
    (shard, run), counts are summed along the runs, and only a run is numbered by one window.
    Equal rows are counted before they move, so a key that holds most rows is one row here.
    """
    spark = df.sparkSession
    worker_imports(spark)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    slim = df.select(
        F.col(f"`{key}`").alias("_key"), whole_key(df, key).alias("_whole"),
        (F.octet_length(body) + ROW_OVERHEAD).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    grouped = slim.groupBy("_key", "_whole", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    placed = staged(grouped.withColumn("shard", shard_of(F.col("_whole"), shards))
                    .withColumn("grown_shard", shard_of(F.col("_whole"), shards + 1)), "shards")
    rows = placed.count()
    runs = max(1, -(-rows // (ROWS_PER_RUN * shards)))
    placed = placed.withColumn("_run", F.pmod(F.xxhash64("_whole", "size", "text_crc32"), F.lit(runs)).cast("int"))
    starts = placed.groupBy("shard", "_run").agg(F.sum("_copies").alias("_n")).select(
        "shard", "_run",
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_run")) - F.col("_n")).alias("_start"))
    along = Window.partitionBy("shard", "_run").orderBy("_whole", "_key", "size", "text_crc32")
    numbered = placed.withColumn("_within", F.sum("_copies").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies"))
    return (numbered.join(starts, ["shard", "_run"])
            .withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
            .select(F.col("_key").alias(key), "size", "text_crc32", "shard", "grown_shard",
                    (F.col("_start") + F.col("_within") + F.col("_slot")).alias("slot")))


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write whole rows below ``path``, one folder per shard; a shard is split over its files by a salt."""
    worker_imports(df.sparkSession)
    placed = df.withColumn("shard", shard_of(whole_key(df, key), shards))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
