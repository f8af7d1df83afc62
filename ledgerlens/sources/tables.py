"""Stored datasets: versioned Parquet folders and the record table about them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.functions.text import quoted
from ledgerlens.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex[:12]}"


#: Has Spark drop the shuffle files of an execution as it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in this block drop their shuffle files at once; else these stay until the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


#: Most slices of a table that is handled a slice at a time, and the rows a slice should have at least.
SLICES, SLICE_ROWS = 32, 500_000


def in_slices(df: DataFrame, key: Column, rows: int = SLICE_ROWS) -> Iterator[DataFrame]:
    """The table in one to ``SLICES`` parts, one after the other; rows of equal ``key`` are in one part.

    It is staged once, so that what is done with a part shuffles that part alone.  A part is deleted when the next
    is asked for.  All rows of one key come together, however many they are.
    """
    spark, path, mark = df.sparkSession, shared_folder(df.sparkSession, "slices"), "_slice"
    while mark in map(str.lower, df.columns):
        mark = f"_{mark}"
    marked = df.withColumn(mark, F.pmod(F.hash(key), F.lit(SLICES)))
    fs, where = _filesystem(spark, path)
    try:
        with freed_shuffles(spark):
            marked.write.partitionBy(mark).option("compression", "zstd").parquet(path)
            held = {r[mark]: r["count"] for r in spark.read.schema(marked.schema).parquet(path).groupBy(mark).count().collect()}
        parts = min(SLICES, max(1, sum(held.values()) // rows))
        for part in range(parts):
            folders = [f"{path}/{mark}={n}" for n in sorted(held) if n % parts == part]
            if folders:
                yield spark.read.schema(df.schema).parquet(*folders)
            elif not held:
                yield spark.createDataFrame([], df.schema)
            for folder in folders:
                fs.delete(_filesystem(spark, folder)[1], True)
    finally:
        fs.delete(where, True)


def dataset_path(root: str, session: str, dataset: str) -> str:
    return f"{root}/{session}/{dataset}"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    """Versions, oldest first; only those whose write has been committed, or all folders of one."""
    fs, where = _filesystem(spark, path)
    if not fs.exists(where):
        return []
    jvm = spark.sparkContext._jvm
    names = [s.getPath() for s in fs.listStatus(where)]
    named = [p for p in names if p.getName().startswith("v") and (not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))]
    return sorted(int(p.getName().removeprefix("v")) for p in named)


def save_dataset(df: DataFrame, root: str, session: str, dataset: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new version beside the old ones; readers see it once it is complete.

    It is written under a name of its own and renamed to the next free number, so two writers
    at a time get two versions and neither fails.
    """
    spark, path = df.sparkSession, dataset_path(root, session, dataset)
    apart = f"{path}/.writing-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(apart)
    fs, source = _filesystem(spark, apart)
    while True:
        known = versions(spark, path, complete=False)
        target = f"{path}/v{(known[-1] if known else 0) + 1}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if not fs.exists(place) and fs.rename(source, place):
            # where another writer's folder was there first, some file systems move ours inside it
            inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, source.getName())
            if not fs.exists(inside):
                return target
            source = inside


def load_dataset(spark: SparkSession, root: str, session: str, dataset: str) -> DataFrame:
    """The newest complete version."""
    path = dataset_path(root, session, dataset)
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no dataset {dataset} in session {session}")
    return spark.read.parquet(f"{path}/v{known[-1]}")


def delete_dataset(spark: SparkSession, root: str, session: str, dataset: str) -> bool:
    fs, where = _filesystem(spark, dataset_path(root, session, dataset))
    return fs.delete(where, True)


def dataset_record(df: DataFrame, dataset_id: str, filename: str, updated_at: str) -> DataFrame:
    """One row about a dataset for the record table."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(filename).alias("filename"), "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"), F.lit(",".join(df.columns)).alias("columns"),
        F.lit(updated_at).cast("timestamp").alias("updated_at"))


def upsert_records(existing: DataFrame, changes: DataFrame, key: str = "dataset_id", order_by: str = "updated_at") -> DataFrame:
    """Insert or replace by key: the newest row of each key wins, a change wins a tie.

    The winner is a max_by, so rows of one key are reduced before the shuffle.
    """
    rest = [c for c in existing.columns if c != key]
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    picked = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order_by, "_new")).alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in existing.columns])


def preview(df: DataFrame, order_by: str, n: int = 20) -> DataFrame:
    """First rows in row order."""
    return df.orderBy(quoted(order_by)).limit(n)
