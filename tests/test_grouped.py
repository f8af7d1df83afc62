"""Exact quantiles of many groups, against numpy and the built-in aggregate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import grouped
from ledgerlens.plans.grouped import grouped_quantiles
from ledgerlens.plans.ranks import Quantile

FRACTIONS = (0.0, 0.25, 0.5, 0.9, 1.0)


def wanted(*columns):
    return [Quantile(f"{c}{i}", F.col(c), f) for c in columns for i, f in enumerate(FRACTIONS)]


@pytest.mark.parametrize("in_memory, per_bracket", [(100_000, None), (0, None), (50, 5), (0, 0)])
def test_matches_numpy(spark, monkeypatch, in_memory, per_bracket):
    monkeypatch.setattr(grouped, "GRID", 16)
    rng = np.random.default_rng(9)
    data = {("hot", "x"): np.round(rng.normal(size=2500), 3), ("hot", None): np.repeat([1.5, 2.5], 70), ("a", "y"): np.array([4.0]),
            (None, None): np.arange(40.0), ("b", "z"): np.concatenate([np.full(300, 7.0), rng.integers(0, 9, 200)])}
    rows = [(g, h, float(v), float(-v) if n % 3 else None) for (g, h), vs in data.items() for n, v in enumerate(vs)] + [("none", "x", None, None)] * 3
    df = spark.createDataFrame(rows, "`the g` string, h string, v double, w double").repartition(3)
    found = {(r[0], r[1]): list(r)[2:] for r in grouped_quantiles(df, ["the g", "h"], wanted("v", "w"), in_memory, per_bracket).collect()}
    assert found.pop(("none", "x")) == [None] * 10
    assert set(found) == set(data)
    for key, own in found.items():
        w = [-v for n, v in enumerate(data[key]) if n % 3]
        assert own[:5] == pytest.approx(list(np.quantile(data[key], FRACTIONS)), abs=1e-12)
        assert own[5:] == (pytest.approx(list(np.quantile(w, FRACTIONS)), abs=1e-12) if w else [None] * 5)


def test_infinite_values_and_nan(spark):
    inf, nan = math.inf, math.nan
    rows = [("a", v) for v in [inf] * 9 + [-inf] * 8 + [nan] * 4 + list(range(20))] + [("b", nan)] * 3 + [("c", inf), ("c", -inf), ("c", 1.0)]
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    small, large = ({r.g: repr(tuple(r)) for r in grouped_quantiles(df, ["g"], wanted("v"), limit).collect()} for limit in (1000, 0))
    assert small == large
