"""Most frequent values by short keys, against plain counts."""

import random
from collections import Counter

import pytest

from ledgerlens.operators import profile
from ledgerlens.plans.catalog import columns_of, leading_values, modes


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    head = "https://host.example/a/very/long/common/path"
    texts = [f"{head}/{rng.randrange(30)}" for _ in range(300)] + [head[:40]] * 9 + [head[:40] + "x"] * 9 + ["short", ""] * 9 + [None] * 5
    rows = [(t, rng.randrange(12) or None, rng.choice([0.5, -1.0, 2.25]), f"{head}/{n}", None) for n, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "t string, i int, d double, `u.u` string, empty string").repartition(4)


def plain(values, first):
    counts = Counter(v for v in values if v is not None)
    return len(counts), sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:first]


@pytest.mark.parametrize("first", [1, 4, 10])
def test_leading_values(table, first):
    rows, df = table
    found = {}
    for r in leading_values(df, columns_of(df), first).orderBy("ordinal", "rank").collect():
        found.setdefault(r.ordinal, []).append((r.distinct, r.rank, r.value, r.n))
    for i in range(4):
        distinct, top = plain([r[i] for r in rows], first)
        assert found[i] == [(distinct, k, str(v), n) for k, (v, n) in enumerate(top, 1)], i
    assert set(found) == {0, 1, 2, 3}


def test_no_key_is_a_whole_text(table):
    _, df = table
    for frame in (modes(df, columns_of(df)), profile.top_values(df)):
        assert frame.count() > 0
    row = {r.column: r for r in profile.profile(df).collect()}
    assert row["t"].mode == min(v for v in [r[0] for r in table[0]] if v and table[0].count and Counter(x[0] for x in table[0])[v] == plain([x[0] for x in table[0]], 1)[1][0][1])
    assert row["u.u"].unique == len(table[0]) and row["empty"].unique == 0 and row["empty"].mode is None
