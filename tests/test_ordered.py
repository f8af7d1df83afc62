"""Sliced order against brute force, with many slices over few rows."""

import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from ledgerlens.operators import evaluate
from ledgerlens.operators.clean import fill_next, fill_previous, interpolate
from ledgerlens.operators.profile import missing_patterns
from ledgerlens.plans import ordered
from ledgerlens.plans.ordered import SLICE, running_totals, sliced


@pytest.fixture(scope="module")
def gaps(spark):
    rng = random.Random(3)
    keys = rng.sample(range(100_000), 500)
    rows = [(k, None if rng.random() < 0.6 else round(rng.uniform(-5, 5), 3)) for k in keys]
    # a long run of nulls that crosses several slices
    low = sorted(keys)[200:320]
    rows = [(k, None if k in low else v) for k, v in rows]
    return spark.createDataFrame(rows, "k bigint, v double"), pd.DataFrame(rows, columns=["k", "v"]).sort_values("k").set_index("k")["v"]


def as_series(df):
    pdf = df.toPandas().sort_values("k").set_index("k")["v"]
    return pdf.astype(float)


def test_slices_follow_the_key(gaps):
    df, _ = gaps
    parts = sliced(df, "k", rows_per_slice=40)
    spans = parts.groupBy(SLICE).agg({"k": "min"}).join(parts.groupBy(SLICE).agg({"k": "max"}), SLICE).orderBy(SLICE).collect()
    assert len(spans) > 5
    assert all(a["max(k)"] < b["min(k)"] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("per_slice, chunk", [(40, 1024), (40, 3), (10_000, 1024)])
def test_carries(gaps, monkeypatch, per_slice, chunk):
    monkeypatch.setattr(ordered, "SLICES_PER_CHUNK", chunk)
    df, series = gaps
    pd.testing.assert_series_equal(as_series(fill_previous(df, "v", "k", per_slice)), series.ffill(), check_dtype=False)
    pd.testing.assert_series_equal(as_series(fill_next(df, "v", "k", per_slice)), series.bfill(), check_dtype=False)
    expected = series.reset_index(drop=True).interpolate("linear").set_axis(series.index)
    pd.testing.assert_series_equal(as_series(interpolate(df, "v", "k", per_slice)), expected, check_dtype=False)


@pytest.mark.parametrize("per_slice", [40, 10_000])
def test_longest_gap(gaps, per_slice):
    df, series = gaps
    runs = series.isna().astype(int)
    longest = (runs.groupby((runs != runs.shift()).cumsum()).sum()).max()
    row = missing_patterns(df, "k", rows_per_slice=per_slice).first()
    assert row["longest_run"] == longest and row["pattern"] == "systematic_blocks"


@pytest.mark.parametrize("key", ["https://host.example/items/{:07d}?page=1", "{:07d}"])
def test_text_keys_are_cut_like_numbers(spark, key):
    rows = [(key.format(n * 37 % 2000), n * 37 % 2000, None if n % 3 else n) for n in range(2000)]
    df = spark.createDataFrame(rows, "u string, n bigint, v bigint")
    sizes = [r["count"] for r in sliced(df, "u", 100).groupBy(SLICE).count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 250
    assert {r.n: r.v for r in fill_previous(df, "v", "u", 100).collect()} == {r.n: r.v for r in fill_previous(df, "v", "n", 100).collect()}


def test_rows_of_one_key_are_divided(spark):
    rows = [(5, n) for n in range(900)] + [(n, n) for n in range(300)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    sizes = [r["count"] for r in sliced(df, "k", 100).groupBy(SLICE).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 250
    out = ordered.numbered(df, "k", 100).orderBy("_rn").collect()
    assert [r._rn for r in out] == list(range(1, 1201)) and [r.k for r in out] == sorted(k for k, _ in rows)


def test_score_curves_in_small_slices(spark, monkeypatch):
    df = spark.range(700).select((F.xxhash64("id") % 2).alias("a"), (F.abs(F.xxhash64("id", F.lit(1)) % 400) / 400).alias("s")).withColumn("a", F.abs("a"))
    whole = evaluate.score_steps(df, "a", "s").orderBy("score").collect()
    monkeypatch.setattr(ordered, "SLICES_PER_CHUNK", 2)
    assert evaluate.score_steps(df, "a", "s", rows_per_slice=30).orderBy("score").collect() == whole


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, monkeypatch, descending):
    monkeypatch.setattr(ordered, "SLICES_PER_CHUNK", 4)
    rows = [(g, float(i), i % 7) for g in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k double, n bigint")
    out = running_totals(df, "k", {"t": "n"}, descending, ("g",), rows_per_slice=50).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "k", "n"]).sort_values("k", ascending=not descending)
    pdf["t"] = pdf.groupby("g")["n"].cumsum()
    merged = out.merge(pdf, on=["g", "k"])
    assert (merged["t_x"] == merged["t_y"]).all() and len(merged) == 600


def test_odd_names_and_text_keys(spark):
    rows = [(f"k{n:03d}'s", n % 7, None if n % 3 else float(n)) for n in range(200)]
    df = spark.createDataFrame(rows, "`the key` string, `a``b` int, `v.w` double")
    for per_slice in (20, 1_000_000):
        filled = {r[0]: r[2] for r in fill_previous(df, "v.w", "the key", per_slice).collect()}
        assert filled == {k: float(n - n % 3) for n, (k, *_) in enumerate(rows)}
    assert sliced(df, "the key", rows_per_slice=20).select(SLICE).distinct().count() >= 8
    with pytest.raises(TypeError):
        sliced(spark.createDataFrame([([1],)], "k array<int>"), "k")
