"""Link discovery over more columns than one mask word holds, against sets."""

import random

from pyspark.sql import functions as F

from ledgerlens.functions.text import indel_ratio
from ledgerlens.operators import links as l


def test_wide_tables_against_sets(spark):
    rng = random.Random(1)
    wide = {}
    for t in range(3):
        data = [[str(rng.randrange(40 + 10 * c)) if rng.random() > 0.1 else None for c in range(30)] for _ in range(60)]
        wide[f"t{t}"] = spark.createDataFrame(data, ", ".join(f"id_{c} string" for c in range(30)))
    found = {(r["source"], r["source_column"], r["target"], r["target_column"]): (r["matched_count"], r["source_unique"])
             for r in l.validate_links(wide).collect()}
    sets = {t: {c: {r[c] for r in df.collect()} - {None} for c in df.columns} for t, df in wide.items()}
    names = list(wide)
    expected = {(a, x, b, y): (len(sets[a][x] & sets[b][y]), len(sets[a][x]))
                for i, a in enumerate(names) for b in names[i + 1:] for x in sets[a] for y in sets[b] if sets[a][x] & sets[b][y]}
    assert found == expected


def test_long_text_links_by_digest(spark):
    long = "x" * 500
    a = spark.createDataFrame([(long + "1",), (long + "2",)], "note_id string")
    b = spark.createDataFrame([(long + "2",), (long + "3",)], "note_id string")
    row = l.validate_links({"a": a, "b": b}).first()
    assert row["matched_count"] == 1 and row["overlap"] == 50.0 and row["strength"] == "moderate"


def test_similarity_of_names(spark):
    cases = [("customer_id", "cust_id"), ("a", "b"), ("order", "order"), ("", "x"), ("o_custkey", "c_custkey")]
    df = spark.createDataFrame(cases, "a string, b string").select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r"))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for r in df.collect():
        assert abs(r["r"] - (2 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"])))) < 1e-12
