"""Screens of value patterns against the plain patterns, on lines made to hold them or nearly."""

import random
import re

from pyspark.sql import functions as F

from ledgerlens.operators import classify as c


def lines():
    rng = random.Random(4)
    parts = ["sku-1", "SKU-", "prod-77", "bin-x", "WH-9", "q7", "Q", "5 hrs", "12hours", "per  hour", "perhour", "3 GB", "3 gb", "calls", "9calls", "$5", "$ 5", "usd", "a@b.com", "@x", "v. ", "v.",
             "case #12", "case12", "case", "ABCD-1234", "abcd-12", "license key", "licensekey", "dim_3", "vec_", "feature_10", "2024-01-02", "1/2/2024", "01/02/2024", "12%", "%", "stars", "4 star", "6 stars",
             "+1234567890", "123456789", "rental period", "strongly agree", "stronglydisagree", "gold", "nps", "\n", "utm_", "x.pdf", ".exe", "OPS-1", "acc-2", "gl-", "İ", "K", "ticket-3", "event-4"]
    return ["", *parts, *["".join(rng.choice(parts) + rng.choice(["", " ", "-", "\n"]) for _ in range(rng.randrange(2, 6))) for _ in range(600)]]


def test_screens_miss_nothing(spark):
    rows = lines()
    df = spark.createDataFrame(list(enumerate(rows)), "n int, line string").withColumn("lowered", F.lower("line"))
    blocks = [list(c.ALL_PATTERNS[i:i + 20]) for i in range(0, len(c.ALL_PATTERNS), 20)]
    found = df.select("n", *[c.pattern_mask(F.col("line"), F.col("lowered"), b).alias(f"m{k}") for k, b in enumerate(blocks)]).collect()
    plain = df.select("n", *[F.col("line").rlike("(?i)" + p).alias(f"p{i}") for i, p in enumerate(c.ALL_PATTERNS)]).collect()
    want = {r.n: [bool(r[f"p{i}"]) for i in range(len(c.ALL_PATTERNS))] for r in plain}
    seen = set()
    for r in found:
        got = [bool(r[f"m{i // 20}"] >> (i % 20) & 1) for i in range(len(c.ALL_PATTERNS))]
        assert got == want[r.n], [p for p, a, b in zip(c.ALL_PATTERNS, got, want[r.n]) if a != b] + [rows[r.n]]
        seen |= {p for p, hit in zip(c.ALL_PATTERNS, got) if hit}
    assert len(seen) > 35


def test_first_rows_and_all_rows_find_the_same(spark, monkeypatch):
    rows = lines()
    df = spark.createDataFrame([(t,) for t in rows], "line string").repartition(3)
    want = sorted(p for p in c.ALL_PATTERNS if any(re.search("(?i)" + p, t) for t in rows if t.isascii()))
    for first in (1, 50, 100_000):
        monkeypatch.setattr(c, "FIRST_ROWS", first)
        found = c.dataset_facts({"a": c.Source(df), "b": c.Source(df.limit(0))}).collect()
        assert {r.dataset: sorted(r.found) for r in found} == {"a": want, "b": []}
    assert [list(r.found) for r in c.dataset_facts({"a": c.Source(df)}, patterns=False).collect()] == [[]]
