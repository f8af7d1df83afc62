"""Evaluation on small hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as e

PAIRS = [(1, 1), (0, 0), (1, 0), (0, 0), (1, 1), (0, 1), (1, 1), (0, 0)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "actual int, predicted int")


def test_confusion_counts(pairs):
    cells = {(r["actual"], r["predicted"]): r["count"] for r in e.confusion_matrix(pairs, "actual", "predicted").collect()}
    assert cells == {(0, 0): 3, (0, 1): 1, (1, 0): 1, (1, 1): 3}


def test_accuracy(pairs):
    row = e.classification_metrics(pairs, "actual", "predicted").first()
    assert row["accuracy"] == 75.0 and row["matthews_corrcoef"] == 0.5 and row["cohen_kappa"] == 0.5


def test_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b"), ("c", "b")], "actual string, predicted string")
    rows = {r["label"]: r for r in e.per_class(df, "actual", "predicted").collect()}
    assert rows["c"]["precision"] == 0.0 and rows["c"]["recall"] == 0.0 and rows["c"]["support"] == 1


def test_auc_by_counting_pairs(spark):
    scored = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.4), (1, 0.4), (0, 0.1), (1, None)]
    df = spark.createDataFrame(scored, "y int, s double")
    full = [(y, s) for y, s in scored if s is not None]
    wins = [(p > n) + 0.5 * (p == n) for y, p in full if y for z, n in full if not z]
    assert e.roc_auc(df, "y", "s").first()["roc_auc"] == round(100 * sum(wins) / len(wins), 2)


def test_score_steps_in_slices(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 701 / 701).alias("s"))
    whole = {r["score"]: (r["tp"], r["fp"]) for r in e.score_steps(df, "y", "s").collect()}
    parts = {r["score"]: (r["tp"], r["fp"]) for r in e.score_steps(df, "y", "s", rows_per_slice=60).collect()}
    assert whole == parts and len(whole) == 701


def test_constant_actuals_have_no_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5), (1.0, 1.0)], "y double, p double")
    row = e.regression_metrics(df, "y", "p").first()
    assert row["r2_score"] is None and row["mae"] == pytest.approx(0.3333)


def test_roles_from_names():
    roles = e.roles_by_name(["sample_id", "y_true", "y_pred", "prob_a", "prob_b", "height"])
    assert roles == {"y_true": "actual", "y_pred": "predicted", "prob_a": "probability", "prob_b": "probability", "sample_id": "id"}
