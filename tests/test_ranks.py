"""Exact quantiles by narrowing, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import ranks
from ledgerlens.plans.ranks import Quantile, quantile_row

FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def narrowed(df, col="v"):
    wanted = [Quantile(f"q{i}", F.col(col), p) for i, p in enumerate(FRACTIONS)]
    return list(quantile_row(df, wanted, in_memory=0).first())


@pytest.mark.parametrize("few", [1_000_000, 5, 0])
def test_matches_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "ROWS_PER_BRACKET", few)
    monkeypatch.setattr(ranks, "SKETCH_ACCURACY", 100)
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=4000), 4)
    values[:1400] = 1.25  # a third of all rows share one value
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 50, "v double")
    assert narrowed(df) == pytest.approx(list(np.quantile(values, FRACTIONS)), abs=1e-12)


def test_constant_and_empty(spark):
    assert narrowed(spark.createDataFrame([(2.0,)] * 30, "v double")) == [2.0] * len(FRACTIONS)
    assert narrowed(spark.createDataFrame([(None,)] * 3, "v double")) == [None] * len(FRACTIONS)


def test_both_ways_agree(spark):
    df = spark.range(1, 1001).select((F.pow("id", F.lit(1.7)) % 97).alias("v"))
    wanted = [Quantile(f"q{i}", F.col("v"), p) for i, p in enumerate(FRACTIONS)]
    assert list(quantile_row(df, wanted).first()) == pytest.approx(narrowed(df), abs=1e-9)


def test_infinite_values_at_any_size(spark):
    values = [float("inf")] * 30 + [float("-inf")] * 20 + [float(v) for v in range(50)] + [float("nan")] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = [Quantile(f"q{i}", F.col("v"), p) for i, p in enumerate(FRACTIONS)]
    small, large = list(quantile_row(df, wanted).first()), narrowed(df)
    assert [repr(v) for v in small] == [repr(v) for v in large]
