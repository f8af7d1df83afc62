"""Ordinary and odd column names through the operator families."""

import datetime as dt

import pytest

from ledgerlens.operators import charts, classify, clean, dashboards, evaluate, filters, links, mapping, profile, score
from ledgerlens.functions.text import quoted
from ledgerlens.sources import canonical, tables

NAMES = ("customer's total", "a.b", "tick`ed", "two words")


@pytest.mark.parametrize("name", NAMES)
def test_families(spark, name):
    q = "`" + name.replace("`", "``") + "`"
    df = spark.createDataFrame([(1, "x", 0.5), (2, "y", 1.5), (3, "x", None)], f"{q} int, label string, `p.q` double")
    assert {r.label: r.value for r in charts.group_agg(df, "label", name).collect()} == {"x": 4.0, "y": 2.0}
    assert filters.slicer_filter(df, {name: [1, 2]}).count() == 2
    assert evaluate.classification_metrics(df, name, name).first() is not None
    assert profile.missing(df).count() >= 1
    source = {"t": classify.Source(df, name, "t.csv")}
    assert classify.content_types(source).count() == 1 and classify.dataset_roles(source).count() == 1
    assert classify.persona(source).count() == 1 and classify.typed_columns(source["t"]).count() == 2
    assert mapping.column_mapping(df).count() == 3
    assert {r.label: r["count"] for r in dashboards.class_balance(df, name).collect()} == {"1": 1, "2": 1, "3": 1}
    assert links.value_sets(df, name, df, name).count() == 3
    assert charts.boxplot_outliers(df, name, name).count() == 0 and charts.first_points(df, name, "p.q", name).count() == 2
    assert [r[0] for r in tables.preview(df, name, 2).collect()] == [1, 2]
    assert [r[0] for r in clean.preview_rows(df, [], name, 2).collect()] == [1, 2]
    assert df.agg(charts.kpi_expr(df, "count_distinct", name)).first()[0] == 3.0
    assert df.where(score.in_holdout(quoted(name), 1.0)).count() == 3
    assert profile.missing_patterns(df, name).count() == 2
    assert clean.fill_missing(df, "p.q", "ffill", order_by=name).where("`p.q` is null").count() == 0


def test_half_a_month_is_rewritten(spark, tmp_path):
    def days(span, value):
        return spark.createDataFrame([(dt.date(2024, 1, d), 1, value) for d in span], "metric_date date, offering_id int, revenue double")

    path = str(tmp_path / "daily")
    canonical.write_daily_metrics(days(range(1, 31), 1.0), path)
    canonical.write_daily_metrics(days(range(16, 31), 2.0), path)
    rows = {r.metric_date.day: r.revenue for r in spark.read.parquet(path).collect()}
    assert rows == {d: 1.0 if d < 16 else 2.0 for d in range(1, 31)}
