"""Correlations of wide tables: the Gram matrix against numpy and against the plain sums."""

import numpy as np
import pytest

from ledgerlens.operators import profile
from ledgerlens.plans import gram
from ledgerlens.plans.catalog import pairwise_correlations


def table(spark, size, rows, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 4))
    values = base @ rng.normal(size=(4, size)) + rng.normal(size=(rows, size)) + rng.integers(0, 1000, size)
    values[:, 1] = 7.0
    gaps = rng.random((rows, size)) < 0.15
    gaps[:, 2], gaps[:, 3] = False, True
    cells = [[None if g else float(v) for v, g in zip(vs, gs)] for vs, gs in zip(values, gaps)]
    names = [f"c.{i}" for i in range(size)]
    return spark.createDataFrame(cells, ", ".join(f"`{n}` double" for n in names)).repartition(5), names, np.where(gaps, np.nan, values)


def wanted(values, i, j):
    both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
    x, y = values[both, i], values[both, j]
    return None if not len(x) or np.ptp(x) == 0 or np.ptp(y) == 0 else np.corrcoef(x, y)[0, 1]


@pytest.mark.parametrize("block, parts", [(None, 256), (7, 2)])
def test_wide_with_gaps(spark, monkeypatch, block, parts):
    monkeypatch.setattr(gram, "PARTS", parts)
    df, names, values = table(spark, 18, 400)
    found = {(r.a, r.b): r for r in gram.wide_correlations(df, names, block).collect()}
    assert set(found) == {(i, j) for i in range(18) for j in range(i + 1, 18)}
    for (i, j), row in found.items():
        want = wanted(values, i, j)
        assert (row.x, row.y) == (names[i], names[j])
        assert row.r == (want if want is None else pytest.approx(want, abs=1e-9)), (i, j)


def test_both_ways_agree(spark):
    df, names, _ = table(spark, 10, 200)
    df = df.selectExpr("*", "CAST(IF(`c.0` > 0, double('nan'), 1) AS double) odd", "CAST(`c.2` * 2 AS DECIMAL(20, 4)) AS twice", "CAST(`c.4` AS int) whole")
    names = [*names, "odd", "twice", "whole"]
    narrow, wide = ({(r.a, r.b): (r.x, r.y, None if r.r is None else round(r.r, 9)) for r in pairwise_correlations(df, names, n).collect()} for n in (99, 1))
    assert narrow == wide and {v[2] for k, v in wide.items() if 10 in k} == {None}


def test_a_thousand_columns(spark):
    df, names, values = table(spark, 1000, 60)
    rows = profile.strong_correlations(df, 5).collect()
    assert len(rows) == 5 and abs(rows[0].correlation) > 0.9
    assert wanted(values, names.index(rows[0].var1), names.index(rows[0].var2)) == pytest.approx(rows[0].correlation, abs=1e-4)
    assert gram.wide_correlations(df.limit(0), names[:20]).filter("r is not null").count() == 0
