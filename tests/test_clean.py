"""Cleaning: nulls, repeats and errors."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean as c
from ledgerlens.operators.filters import convert_type, slicer_filter


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, None if i % 10 == 0 else float(i % 30), "x" if i % 3 else None) for i in range(300)] + [(1000, 900.0, "y"), (1001, -900.0, "y")]
    return spark.createDataFrame(rows, "id bigint, v double, s string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clipping_twice_changes_nothing(table):
    once = c.treat_outliers(table, "v", "cap_iqr")
    assert rows(c.treat_outliers(once, "v", "cap_iqr")) == rows(once)
    assert once.where("v is null").count() == 30


def test_removing_outliers_keeps_nulls(table):
    left = c.treat_outliers(table, "v", "remove")
    assert left.count() == 300 and left.where("v is null").count() == 30


def test_unknown_column_or_method_changes_nothing(table):
    assert c.fill_missing(table, "nope", "fill_mean") is table
    assert c.treat_outliers(table, "s", "remove") is table
    assert rows(c.fill_missing(table, "v", "keep")) == rows(table)


def test_formula_errors_are_reported(table):
    same, error = c.custom_formula(table, "v", "no_such_function(v)")
    assert same is table and error.startswith("Error")
    doubled, error = c.custom_formula(table, "v", "v * 2")
    assert error is None and doubled.agg(F.max("v")).first()[0] == 1800.0


def test_keep_first_and_last_by_row_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "a")], "k int, g string")
    assert rows(c.drop_duplicates(df, "first", "k", ["g"])) == [(1, "a"), (2, "b")]
    assert rows(c.drop_duplicates(df, "last", "k", ["g"])) == [(2, "b"), (5, "a")]


def test_fold_equals_single_steps(table):
    steps = [c.Cleaning("Missing Values", "v", "fill_median"), c.Cleaning("outliers", "v", "replace_mean"), c.Cleaning("Drop Column", "s")]
    expected = c.treat_outliers(c.fill_missing(table, "v", "fill_median"), "v", "replace_mean").drop("s")
    assert rows(c.apply(table, steps)) == rows(expected)


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("2.5",), ("x",), (None,)], "s string")
    assert [r[0] for r in convert_type(df, "s", "int").collect()] == [1, 2, None, None, None]
    assert [r[0] for r in convert_type(df, "s", "float").collect()] == [1.0, 2.0, 2.5, None, None]


def test_filter_then_aggregate_is_conditional_aggregate(table):
    kept = slicer_filter(table, {"s": "x"}).agg(F.sum("v")).first()[0]
    assert kept == table.agg(F.sum(F.when(F.col("s") == "x", F.col("v")))).first()[0]


def test_default_impute(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "b")], "n double, t string")
    assert rows(c.default_impute(df)) == [(1.0, "a"), (2.0, "b"), (3.0, "Unknown")]


def test_report_of_applied_steps(table):
    steps = [c.Cleaning("missing_values", "v", "median"), c.Cleaning("outliers", "v", "cap_iqr")]
    done, report = c.apply_with_report(table, steps)
    assert rows(done) == rows(c.apply(table, steps)) and report.count() == 2
