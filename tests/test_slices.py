"""A table handled a slice at a time: whole keys, all rows, and nothing left on disk."""

import functools
import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import canonical, tables
from workload.compare import check, sql_connection
from workload.registry import queries

SF_DIR = os.environ.get("LEDGERLENS_SF_DIR", "/root/testdata/sf0.001")


def shuffle_files(spark) -> set[str]:
    """Shuffle data that the session holds on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(n).getName() for n in range(files.size()))
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def left_over(spark, before: set[str]) -> set[str]:
    """Shuffle data since ``before`` that stays; Spark drops it in the background."""
    for _ in range(30):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("freeing", [None, "false"])
def test_slices_hold_whole_keys(spark, tmp_path, monkeypatch, freeing):
    monkeypatch.setattr(tables, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    if freeing:
        spark.conf.set(tables.FREE_SHUFFLES, freeing)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 97).cast("int"))
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 > 0, day).alias("day"), F.lit("x").alias("_SLICE")).repartition(5, "id")
    before, seen, ids = shuffle_files(spark), {}, []
    for n, part in enumerate(tables.in_slices(df, F.col("day"), rows=200)):
        assert part.dtypes == df.dtypes
        for r in part.collect():
            assert seen.setdefault(r.day, n) == n
            ids.append(r.id)
    assert sorted(ids) == list(range(3000)) and None in seen and len(set(seen.values())) > 5
    assert not list(tmp_path.iterdir()) and not left_over(spark, before)
    assert spark.conf.get(tables.FREE_SHUFFLES, None) == freeing
    spark.conf.unset(tables.FREE_SHUFFLES)


def test_slices_of_an_empty_table(spark):
    assert [(p.count(), p.columns) for p in tables.in_slices(spark.range(0), F.col("id"))] == [(0, ["id"])]


def test_rollup_keeps_no_shuffle_files(spark, monkeypatch):
    """A slice at a time the rollup agrees with its SQL, and what one write shuffled is gone before the next."""
    before, left, write = shuffle_files(spark), [], canonical.write_daily_metrics

    def watched(*given):
        write(*given)
        left.append(left_over(spark, before))

    monkeypatch.setattr(canonical, "write_daily_metrics", watched)
    if hasattr(tables, "in_slices"):
        monkeypatch.setattr(tables, "in_slices", functools.partial(tables.in_slices, rows=600))
    ok, note = check(spark, sql_connection(SF_DIR), SF_DIR, "tenant_rollup")
    assert ok, note
    assert not set().union(*left) and len(left) > 5


def test_rollup_of_no_sales(spark, tmp_path):
    for name in ("lineitem", "orders", "part"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    df = queries()["tenant_rollup"](spark, str(tmp_path))
    assert df.columns == ["metric_date", "offerings", "transactions", "revenue"] and df.count() == 0


def daily(spark, rows: int):
    """Rows of one busy day and of a quiet one, by digests."""
    return spark.range(rows).select(
        F.lit("t").alias("tenant_id"), F.when(F.col("id") < 10, F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("date").alias("metric_date"),
        F.sha2(F.col("id").cast("string"), 256).alias("offering_id"), F.lit(1.0).alias("revenue"))


def test_stored_digests_are_packed(spark, tmp_path):
    """A digest has 32 bytes and is written with 64 digits."""
    canonical.write_daily_metrics(daily(spark, 40_000), str(tmp_path / "days"))
    assert sum(f.stat().st_size for f in (tmp_path / "days").rglob("*.parquet")) < 40_000 * 40


@pytest.mark.parametrize("day", ["2024-01-01", None])
def test_a_busy_day_has_several_files(spark, tmp_path, monkeypatch, day):
    monkeypatch.setattr(canonical, "DAY_ROWS", 20_000)
    rows = daily(spark, 60_010).withColumn("metric_date", F.when(F.col("metric_date") > "2024-01-01", F.col("metric_date")).otherwise(F.lit(day).cast("date")))
    files = canonical.files_of_days(rows.withColumnRenamed("metric_date", "transaction_date"))
    assert files == {day or "": 3}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        canonical.write_daily_metrics(rows, str(tmp_path / "days"), files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    held = {d.name.removeprefix("metric_day="): len(list(d.glob("*.parquet"))) for d in (tmp_path / "days").iterdir() if d.is_dir()}
    assert held == {day or "__HIVE_DEFAULT_PARTITION__": 3, "2024-01-02": 1}
    stored = canonical.read_daily_metrics(spark, str(tmp_path / "days"))
    assert stored.count() == stored.select("offering_id").distinct().count() == 60_010
