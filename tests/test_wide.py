"""Profiles of tables with many numeric columns."""

from pyspark.sql import functions as F

from ledgerlens.operators import dashboards, profile


def test_columns_past_the_twentieth_count(spark):
    names = [f"c{i:02d}" for i in range(24)]
    df = spark.range(40).select(*[(F.xxhash64("id", F.lit(i)) % 1000).alias(n) for i, n in enumerate(names[:-1])])
    df = df.withColumn(names[-1], F.col(names[-2]) * 2 + 1)
    matrix = {(r.x, r.y): r.value for r in profile.correlation_matrix(df).collect()}
    assert len(matrix) == 24 * 24 and matrix["c22", "c23"] == 1.0
    assert ("c22", "c23") in {(r.var1, r.var2) for r in profile.strong_correlations(df).collect()}
    assert [r.feature for r in profile.feature_table(df).orderBy("feature").collect()] == names
    parts = dashboards.statistics(df.select(*names[:1], *names[2:]))
    assert {r.x for r in parts["correlations"].select("x").distinct().collect()} == {*names} - {"c01"}
    assert profile.correlation_matrix(df, most=2).count() == 4
