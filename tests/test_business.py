"""Rules, offerings and classifiers on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import classify as c
from ledgerlens.operators import insights as i
from ledgerlens.operators import mapping as m
from ledgerlens.operators import offerings as o


def test_each_rule_fires_at_its_limit(spark):
    fields = "id string, name string, revenue double, profit double, margin double, transactions bigint, top_customer_pct double, revenue_trend double, stability_score double, repeat_rate_decline double"
    rows = [
        ("loss", "A", 100.0, -50.0, -50.0, 10, 0.0, 0.0, 1.0, 0.0), ("thin", "B", 100.0, 4.0, 4.0, 10, 0.0, 0.0, 1.0, 0.0),
        ("edge", "C", 100.0, 5.0, 5.0, 200, 50.0, -0.15, 0.4, 0.2), ("many", "D", 100.0, 10.0, 10.0, 101, 51.0, -0.16, 0.39, 0.21),
        ("rich", "E", 100.0, 40.0, 40.0, 49, None, None, None, None),
    ]
    fired = {}
    for r in i.evaluate_rules(spark.createDataFrame(rows, fields)).collect():
        fired.setdefault(r["offering_id"], set()).add(r["insight_type"])
    assert fired == {"loss": {"LOSS_001"}, "thin": {"LOSS_002"}, "many": {"RISK_001", "RISK_002", "RISK_003", "GROWTH_002", "CHURN_001"},
                     "rich": {"GROWTH_001"}}


def test_texts(spark):
    df = spark.createDataFrame([("x", "Pen", 100.0, -50.0, -50.0, 3)], "id string, name string, revenue double, profit double, margin double, transactions bigint")
    row = i.evaluate_rules(df).first()
    assert row["recommendation"] == ("Review pricing or discontinue 'Pen'. Current loss: $50.00. Consider increasing price by 50% to break even.")
    assert row["title"] == "Negative Profit Offering: Pen" and row["confidence"] == 0.95


def test_gaps_with_a_hot_offering(spark):
    """A third of all sales belong to one offering; gaps equal those of a plain scan."""
    start = dt.date(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(days=(n * n) % 97)) for n in range(300)] + [(f"o{n % 50}", start + dt.timedelta(days=n)) for n in range(600)]
    got = {r["offering_id"]: r for r in o.interval_regularity(spark.createDataFrame(rows, "offering_id string, transaction_date date")).collect()}
    for key in ("hot", "o3"):
        days = sorted(d for k, d in rows if k == key)
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        mean = sum(gaps) / len(gaps)
        std = (sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) ** 0.5
        assert abs(got[key]["mean_gap"] - mean) < 1e-3 and abs(got[key]["std_gap"] - std) < 1e-3


def frame(spark, rows, schema, name):
    return {name: c.Source(spark.createDataFrame(rows, schema), schema.split()[0], name)}


def test_content_of_known_tables(spark):
    sales = frame(spark, [(n, n * 10.0, f"u{n}@x.com", f"SKU-{n}") for n in range(10)],
                  "transaction_id int, revenue double, customer_email string, product_sku string", "sales_jan_2024.csv")
    training = frame(spark, [(n, n, n % 2) for n in range(10)], "feature_1 int, feature_2 int, target_class int", "training_dataset.csv")
    survey = frame(spark, [(n, n % 5, "strongly agree") for n in range(10)], "respondent_id int, q1_satisfaction int, q2_feedback string", "survey_results.csv")
    kinds = {r["dataset"]: r["content_type"] for r in c.content_types({**sales, **training, **survey}).collect()}
    assert kinds["training_dataset.csv"] == "training_dataset"
    assert kinds["sales_jan_2024.csv"] in ("sales_transactions", "products_catalog", "customers")
    assert kinds["survey_results.csv"] in ("customer_feedback", "survey_data")


def test_mapping_uses_each_field_once(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 9.5, 2, "c1")], "order_id int, order_date date, total double, qty int, customer_id string")
    rows = {r["original_column"]: r["canonical_field"] for r in m.column_mapping(df).collect()}
    assert rows["order_date"] == "transaction_date" and rows["total"] == "amount" and rows["qty"] == "quantity"
    assert rows["customer_id"] == "customer_id" and len(set(rows.values())) == len(rows)


def test_model_files_speak_for_engineering(spark):
    s = frame(spark, [(1, 2.0)], "row int, thing double", "notes.csv")
    s["net"] = c.Source(spark.createDataFrame([(1,)], "status int"), "status", "net.onnx", is_model=True)
    row = c.persona(s).first()
    assert row["persona"] == "ml_engineer" and row["dashboard_type"] == "ml_model_dashboard"
    assert c.persona(s).select(F.col("ml_engineer_score")).first()[0] >= 5.0
