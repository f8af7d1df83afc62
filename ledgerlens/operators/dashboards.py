"""Dashboards as tables of chart specifications, and the charts' data.

A specification is chosen from the column names and kinds of a table.  Running
it shares work: all KPI cards come from one aggregate and all charts over the
same axis from one grouping.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.numbers import plain_text, ratio, rounded
from ledgerlens.functions.text import fill_template, quoted
from ledgerlens.operators import charts as c
from ledgerlens.operators import kpis as k
from ledgerlens.operators import profile as p
from ledgerlens.operators.evaluate import classification_metrics, confusion_chart, roc_curve
from ledgerlens.operators.filters import column_kinds, errors_only, slicer_filter, slicer_options
from ledgerlens.plans.catalog import columns_of, local_table, numeric_names, union_all


@dataclass(frozen=True)
class Chart:
    """One chart: where it sits, what it shows, over which columns."""

    tab: str
    id: str
    title: str
    type: str
    x: str | None = None
    y: str | None = None
    agg: str | None = None
    limit: int = 20
    sort: str | None = "desc"
    format: str = "number"


# Which columns a role may use, and the name fragments that pick one.
BUSINESS_ROLES = {
    "revenue": ("numeric", ("revenue", "sales", "amount", "total", "value", "price")),
    "quantity": ("numeric", ("quantity", "qty", "units", "count", "volume")),
    "profit": ("numeric", ("profit", "margin", "net", "gross")), "cost": ("numeric", ("cost", "expense", "spend")),
    "date": ("datetime", ("date", "time", "created", "order_date", "transaction")),
    "category": ("categorical", ("category", "product", "type", "segment", "department")),
    "region": ("categorical", ("region", "branch", "store", "location", "territory", "city")),
    "customer": ("categorical", ("customer", "client", "buyer", "account")),
}
MODEL_ROLES = {
    "predicted": ("all", ("prediction", "predicted", "pred", "y_pred", "output")),
    "actual": ("all", ("actual", "true", "label", "y_true", "target", "ground_truth")),
    "probability": ("numeric", ("probability", "prob", "confidence", "score")),
}
# Charts of the business dashboard, columns given by role.
BUSINESS_CHARTS = (
    Chart("overview", "total_revenue", "Total Revenue", "kpi", None, "revenue", "sum", format="currency"),
    Chart("overview", "total_profit", "Total Profit", "kpi", None, "profit", "sum", format="currency"),
    Chart("overview", "total_units", "Units Sold", "kpi", None, "quantity", "sum"),
    Chart("overview", "total_transactions", "Total Transactions", "kpi", None, None, "count"),
    Chart("overview", "revenue_trend", "Revenue Trend", "line", "date", "revenue", "sum"),
    Chart("overview", "revenue_by_category", "Revenue by {category}", "bar", "category", "revenue", "sum"),
    Chart("overview", "revenue_by_region", "Performance by {region}", "bar", "region", "revenue", "sum"),
    Chart("sales", "category_distribution", "Sales Distribution", "pie", "category", "revenue", "sum"),
    Chart("sales", "monthly_sales", "Monthly Sales Comparison", "month_bar", "date", "revenue", "sum"),
    Chart("sales", "top_performers", "Top Performers", "horizontal_bar", "category", "revenue", "sum", 10),
    Chart("customers", "unique_customers", "Unique Customers", "kpi", "customer", None, "count_distinct"),
    Chart("customers", "revenue_per_customer", "Avg Revenue per Customer", "kpi", "customer", "revenue", "avg_per_group"),
    Chart("customers", "top_customers", "Top Customers by Revenue", "horizontal_bar", "customer", "revenue", "sum", 15),
    Chart("regions", "regions_count", "Total Regions/Branches", "kpi", "region", None, "count_distinct"),
    Chart("regions", "region_comparison", "Regional Revenue Comparison", "bar", "region", "revenue", "sum"),
    Chart("regions", "region_share", "Regional Market Share", "pie", "region", "revenue", "sum"),
    Chart("data", "data_table", "Raw Data", "table"),
)
# Charts of the model dashboard, columns given by role.
MODEL_CHARTS = (
    Chart("overview", "sample_count", "Total Samples", "kpi", None, None, "count"),
    Chart("overview", "accuracy", "Accuracy", "gauge", "predicted", "actual", "accuracy"),
    Chart("overview", "confusion_matrix", "Confusion Matrix", "heatmap", "predicted", "actual", "confusion"),
    Chart("overview", "prediction_dist", "Prediction Distribution", "bar", "predicted", None, "count"),
    Chart("metrics", "precision", "Precision", "kpi", "predicted", "actual", "precision"),
    Chart("metrics", "recall", "Recall", "kpi", "predicted", "actual", "recall"),
    Chart("metrics", "f1_score", "F1 Score", "kpi", "predicted", "actual", "f1"),
    Chart("metrics", "roc_curve", "ROC Curve", "roc", "probability", "actual", None),
    Chart("metrics", "confidence_dist", "Confidence Distribution", "histogram", "probability"),
    Chart("errors", "error_rate", "Error Rate", "kpi", "predicted", "actual", "error_rate"),
    Chart("errors", "misclassified", "Misclassified Samples", "table", "predicted", "actual", "errors_only"),
    Chart("predictions", "pred_table", "All Predictions", "table"),
)
# Sheets per domain: roles and charts.
SHEETS = {
    "sales": (
        {"revenue": ("numeric", ("revenue", "sales", "amount", "total", "price")), "date": ("datetime", ("date", "time", "created", "order")),
         "category": ("categorical", ("category", "product", "type", "region", "segment"))},
        (Chart("overview", "total_revenue", "Total Revenue", "kpi", None, "revenue", "sum"),
         Chart("overview", "avg_order", "Avg Order Value", "kpi", None, "revenue", "avg"),
         Chart("overview", "total_records", "Total Records", "kpi", None, None, "count"),
         Chart("overview", "revenue_trend", "Revenue Trend", "line", "date", "revenue", "sum"),
         Chart("overview", "revenue_by_category", "Revenue by {category}", "bar", "category", "revenue", "sum"),
         Chart("overview", "category_distribution", "{category} Distribution", "pie", "category", None, "count"),
         Chart("details", "data_table", "Raw Data", "table"))),
    "product": (
        {"price": ("numeric", ("price", "cost", "msrp", "value")), "category": ("categorical", ("category", "type", "brand", "department"))},
        (Chart("catalog", "avg_price", "Avg Price", "kpi", None, "price", "avg"),
         Chart("catalog", "product_count", "Total Products", "kpi", None, None, "count"),
         Chart("catalog", "price_by_category", "Price Distribution by Category", "bar", "category", "price", "avg"))),
    "customer": (
        {"segment": ("categorical", ("segment", "tier", "type", "plan", "status")), "value": ("numeric", ("value", "revenue", "spend", "amount", "ltv"))},
        (Chart("customers", "total_customers", "Total Customers", "kpi", None, None, "count"),
         Chart("customers", "customer_segments", "Customer Segments", "pie", "segment", None, "count"),
         Chart("customers", "value_by_segment", "Value by Segment", "bar", "segment", "value", "sum"))),
    "financial": (
        {"amount": ("numeric", ("amount", "total", "value", "balance", "revenue", "cost")), "date": ("datetime", ("date", "time", "period")),
         "type": ("categorical", ("type", "category", "account", "department"))},
        (Chart("financials", "total_amount", "Total Amount", "kpi", None, "amount", "sum"),
         Chart("financials", "transaction_count", "Transactions", "kpi", None, None, "count"),
         Chart("financials", "amount_trend", "Financial Trend", "line", "date", "amount", "sum"),
         Chart("financials", "amount_by_type", "Amount by {type}", "bar", "type", "amount", "sum"))),
    "hr": (
        {"salary": ("numeric", ("salary", "wage", "compensation", "pay")), "department": ("categorical", ("department", "team", "division", "unit"))},
        (Chart("workforce", "headcount", "Total Headcount", "kpi", None, None, "count"),
         Chart("workforce", "avg_salary", "Avg Salary", "kpi", None, "salary", "avg"),
         Chart("workforce", "by_department", "By Department", "bar", "department", None, "count"))),
    "ml": (
        {"predicted": ("values", ("prediction", "predicted", "pred", "output", "score")), "label": ("values", ("label", "target", "actual", "true", "class")),
         "probability": ("numeric", ("probability", "prob", "confidence", "score"))},
        (Chart("model_metrics", "sample_count", "Total Samples", "kpi", None, None, "count"),
         Chart("model_metrics", "prediction_dist", "Prediction Distribution", "bar", "predicted", None, "count"),
         Chart("model_metrics", "label_dist", "Label Distribution", "pie", "label", None, "count"),
         Chart("model_metrics", "confidence_hist", "Confidence Distribution", "histogram", "probability"))),
    "legal": (
        {"status": ("categorical", ("status", "state", "stage", "outcome")), "type": ("categorical", ("type", "category", "matter", "case_type"))},
        (Chart("cases", "total_cases", "Total Cases", "kpi", None, None, "count"),
         Chart("cases", "by_status", "Cases by Status", "pie", "status", None, "count"),
         Chart("cases", "by_type", "Cases by Type", "bar", "type", None, "count"))),
    "generic": (
        {"category": ("categorical", ()), "date": ("datetime", ()), "number": ("numeric", ())},
        (Chart("explorer", "total_records", "Total Records", "kpi", None, None, "count"),
         Chart("explorer", "cat_dist", "Distribution of {category}", "bar", "category", None, "count"),
         Chart("explorer", "time_trend", "Trend Over Time", "line", "date", "number", "sum"),
         Chart("explorer", "data_table", "Data Preview", "table"))),
}
# Which sheet shows a content type.
SHEET_OF_CONTENT = {
    "sales_transactions": "sales", "orders": "sales", "products_catalog": "product", "inventory": "product", "customers": "customer",
    "subscriptions": "customer", "financial_data": "financial", "invoices": "financial", "employees": "hr", "training_dataset": "ml",
    "embeddings": "ml", "legal_cases": "legal", "contracts": "legal",
}


def column_groups(df: DataFrame) -> dict[str, list[str]]:
    """Column names per kind (numeric, categorical, datetime, text, all), in table order."""
    rows = column_kinds(df).orderBy("ordinal").collect()
    groups: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "text": [], "all": [r["column"] for r in rows]}
    for r in rows:
        groups.setdefault(r["group"], []).append(r["column"])
    return groups


def sheet_groups(df: DataFrame) -> dict[str, list[str]]:
    """Like ``column_groups``, with identifiers set apart."""
    groups = column_groups(df)
    ids = [n for n in groups["all"] if "id" in n.lower() or "key" in n.lower()]
    out = {kind: [n for n in names if n not in ids] for kind, names in groups.items() if kind != "all"}
    return {**out, "id": ids, "all": groups["all"], "values": out["numeric"] + out["categorical"]}


def find_column(columns: list[str], fragments: tuple[str, ...], strict: bool = True) -> str | None:
    """First column whose name holds a fragment; the first column if any will do (no fragments, or not ``strict``)."""
    if not fragments:
        strict = False
    found = next((n for n in columns if any(w in n.lower() for w in fragments)), None)
    return found or (None if strict or not columns else columns[0])


def resolve(charts: tuple[Chart, ...], roles: dict, groups: dict[str, list[str]], strict: bool = True) -> list[Chart]:
    """Charts whose roles are all filled, with columns in place of roles."""
    columns = {role: find_column(groups.get(kind, []), words, strict) for role, (kind, words) in roles.items()}
    out = []
    for chart in charts:
        if all(role is None or columns.get(role) for role in (chart.x, chart.y)):
            title = chart.title.format(**{r: n for r, n in columns.items() if n})
            out.append(replace(chart, title=title, x=columns.get(chart.x), y=columns.get(chart.y)))
    return out


def business_charts(df: DataFrame, strict: bool = True) -> list[Chart]:
    groups = column_groups(df)
    out = resolve(BUSINESS_CHARTS, BUSINESS_ROLES, groups, strict)
    ids = {ch.id for ch in out}
    revenue, cost = (find_column(groups["numeric"], BUSINESS_ROLES[r][1], strict) for r in ("revenue", "cost"))
    if "total_profit" not in ids and revenue and cost:
        gross = Chart("overview", "total_profit", "Gross Profit", "kpi", None, f"{revenue}-{cost}", "calculated", format="currency")
        out.insert(1, gross)
    return out


def analytics_charts(df: DataFrame) -> list[Chart]:
    groups = column_groups(df)
    numbers, categories = groups["numeric"][:6], groups["categorical"][:4]
    out = [Chart("statistics", "total_records", "Total Records", "kpi", None, None, "count"),
           Chart("statistics", "total_columns", "Total Features", "kpi", None, None, "column_count"),
           Chart("statistics", "missing_pct", "Data Completeness", "kpi", None, None, "completeness", format="percent")]
    out += [Chart("statistics", f"dist_{n}", f"Distribution: {n}", "histogram", n) for n in numbers[:3]]
    out += [Chart("distributions", f"box_{n}", f"Box Plot: {n}", "boxplot", n) for n in numbers[:4]]
    out += [Chart("distributions", f"cat_dist_{n}", f"Distribution: {n}", "bar", n, None, "count") for n in categories[:3]]
    if len(numbers) >= 2:
        out.append(Chart("correlations", "correlation_matrix", "Correlation Matrix", "heatmap", ",".join(numbers)))
        out += [Chart("correlations", f"scatter_{i + 1}", f"{numbers[2 * i]} vs {numbers[2 * i + 1]}", "scatter", numbers[2 * i], numbers[2 * i + 1])
                for i in range(2) if len(numbers) >= 2 * i + 2]
    date = find_column(groups["datetime"], ("date", "time", "timestamp"), strict=False)
    if date:
        out += [Chart("time_series", f"trend_{n}", f"{n} Over Time", "line", date, n, "avg") for n in numbers[:3]]
    return out + [Chart("quality", "missing_by_column", "Missing Values by Column", "bar", None, None, "missing_count"),
                  Chart("quality", "data_types", "Data Type Distribution", "pie", None, None, "dtype_count"),
                  Chart("data", "data_table", "Raw Data", "table")]


def model_charts(df: DataFrame, strict: bool = True) -> list[Chart]:
    groups = column_groups(df)
    out = resolve(MODEL_CHARTS, MODEL_ROLES, groups, strict)
    used = {find_column(groups[kind], words, strict) for kind, words in MODEL_ROLES.values()}
    features = [n for n in groups["numeric"] if n not in used]
    shown = [Chart("features", "feature_importance", "Feature Importance", "horizontal_bar", ",".join(features[:10]), None, "feature_importance")] if features else []
    shown += [Chart("features", f"feature_{n}", f"Feature: {n}", "histogram", n) for n in features[:4]]
    at = next((i for i, ch in enumerate(out) if ch.tab in ("errors", "predictions")), len(out))
    return out[:at] + shown + out[at:]


def science_charts(df: DataFrame) -> list[Chart]:
    out = analytics_charts(df)
    target = find_column(df.columns, ("prediction", "predicted", "pred", "target", "label"))
    at = next(i for i, ch in enumerate(out) if ch.tab not in ("statistics", "distributions"))
    extra = [Chart("modeling", "target_dist", "Target Distribution", "bar", target, None, "count"),
             Chart("modeling", "target_balance", "Class Balance", "pie", target, None, "count")] if target else []
    return out[:at] + extra + out[at:]


def general_charts(df: DataFrame) -> list[Chart]:
    groups = column_groups(df)
    out = [Chart("overview", "total_rows", "Total Records", "kpi", None, None, "count"),
           Chart("overview", "total_cols", "Total Columns", "kpi", None, None, "column_count")]
    out += [Chart("overview", "num_dist", f"Distribution: {n}", "histogram", n) for n in groups["numeric"][:1]]
    out += [Chart("overview", "cat_dist", f"Distribution: {n}", "bar", n, None, "count") for n in groups["categorical"][:1]]
    return out + [Chart("data", "data_table", "Data", "table")]


def sheet_charts(df: DataFrame, domain: str) -> list[Chart]:
    """Charts of a domain sheet; unknown domains get the generic one."""
    roles, charts = SHEETS.get(domain, SHEETS["generic"])
    return resolve(charts, roles, sheet_groups(df))


PERSONA_CHARTS = {"business": business_charts, "analytics": analytics_charts, "ml_engineer": model_charts, "data_scientist": science_charts}


def dashboard(df: DataFrame, persona: str) -> list[Chart]:
    return PERSONA_CHARTS.get(persona, general_charts)(df)


def spec_table(df: DataFrame, charts: list[Chart]) -> DataFrame:
    """The specification as rows."""
    rows = [(i, ch.tab, ch.id, ch.title, ch.type, ch.x, ch.y, ch.agg) for i, ch in enumerate(charts)]
    return local_table(df.sparkSession, rows, "position int, tab string, id string, title string, type string, x_column string, y_column string, aggregation string")


GROUPED_TYPES = ("bar", "pie", "horizontal_bar", "line", "area", "month_bar")
SCORE_KPIS = {"precision": "precision_weighted", "recall": "recall_weighted", "f1": "f1_weighted"}


def _series(name: str, df: DataFrame, label: Column, value: Column) -> DataFrame:
    return df.select(F.lit(name).alias("chart_id"), label.cast("string").alias("label"), value.cast("double").alias("value"))


def time_units(df: DataFrame, charts: list[Chart]) -> dict[str, str]:
    """Width of the points of time charts over raw timestamps: days up to three months, weeks up to three years, else months."""
    moments = {ch.x for ch in charts if ch.type in ("line", "area") and ch.x in df.columns and dict(df.dtypes)[ch.x].startswith("timestamp")}
    out = {}
    for x in sorted(moments):
        at = quoted(x).cast("timestamp")
        days = df.agg(F.datediff(F.max(at), F.min(at)).alias("d")).first()["d"] or 0
        out[x] = "day" if days <= 92 else "week" if days <= 1096 else "first_of_month"
    return out


def _axis(ch: Chart, units: dict[str, str]) -> tuple[str, str]:
    if ch.type == "month_bar":
        return ch.x, "month"
    return ch.x, units.get(ch.x, "value") if ch.type in ("line", "area") else "value"


def _grouped_values(df: DataFrame, axis: tuple[str, str], members: list[Chart]) -> DataFrame:
    """One grouping that holds the values of every chart over an axis."""
    key = quoted(axis[0])
    if axis[1] == "month":
        key = F.date_format(F.date_trunc("month", key), "yyyy-MM")
    elif axis[1] != "value":
        key = F.date_format(F.date_trunc(axis[1].removeprefix("first_of_"), key), "yyyy-MM-dd")
    aggs = {}
    for ch in members:
        if ch.y is None:
            aggs[ch.id] = F.count(F.lit(1)).cast("double")
        else:
            y = quoted(ch.y).cast("double")
            fn = {"avg": F.avg, "min": F.min, "max": F.max}.get(ch.agg, lambda v: F.coalesce(F.sum(v), F.lit(0.0)))
            aggs[ch.id] = rounded(fn(y), 4)
    return df.where(quoted(axis[0]).isNotNull()).groupBy(key.alias("label")).agg(*[v.alias(n) for n, v in aggs.items()])


def compile_charts(df: DataFrame, charts: list[Chart], order_by: str) -> DataFrame:
    """(chart_id, label, value) of every chart that has values; tables are read with ``table_rows``."""
    parts: list[DataFrame] = []
    cards = [ch for ch in charts if ch.type == "kpi" and ch.agg not in SCORE_KPIS or ch.type == "gauge"]
    if cards:
        wide = c.kpi_cards(df, [{"id": ch.id, "agg": ch.agg, "x": ch.x, "y": ch.y, "format": ch.format} for ch in cards])
        parts.append(wide.select(F.col("id").alias("chart_id"), F.lit(None).cast("string").alias("label"), "value"))
    axes: dict[tuple[str, str], list[Chart]] = {}
    units = time_units(df, charts)
    for ch in charts:
        if ch.type in GROUPED_TYPES and ch.x in df.columns and ch.agg != "feature_importance":
            axes.setdefault(_axis(ch, units), []).append(ch)
    for axis, members in axes.items():
        grouped = _grouped_values(df, axis, members)
        for ch in members:
            if ch.type in ("line", "area", "month_bar"):
                shown = grouped
            else:
                side = F.col(ch.id).asc_nulls_last() if ch.sort == "asc" else F.col(ch.id).desc_nulls_last()
                shown = grouped.orderBy(side, F.col("label")).limit(ch.limit)
            parts.append(_series(ch.id, shown, F.col("label"), F.col(ch.id)))
    for ch in charts:
        part = _single(df, ch, order_by)
        if part is not None:
            parts.append(part)
    return union_all(parts)


def _single(df: DataFrame, ch: Chart, order_by: str) -> DataFrame | None:
    if ch.type == "histogram" and ch.x in df.columns:
        h = c.histogram(df, ch.x)
        return _series(ch.id, h, F.concat(plain_text(rounded(F.col("lower"), 2), 2), F.lit("-"), plain_text(rounded(F.col("upper"), 2), 2)), F.col("count"))
    if ch.type == "boxplot" and ch.x in df.columns:
        names = ("min", "q1", "median", "q3", "max", "lower_fence", "upper_fence")
        return c.boxplot(df, ch.x).select(F.lit(ch.id).alias("chart_id"), F.inline(F.array(*[
            F.struct(F.lit(n).alias("label"), F.col(n).alias("value")) for n in names])))
    if ch.type == "heatmap" and ch.agg == "confusion":
        return _series(ch.id, confusion_chart(df, ch.y, ch.x), F.concat_ws("|", "x", "y"), F.col("value"))
    if ch.type == "heatmap":
        names = ch.x.split(",") if ch.x else numeric_names(df)
        return _series(ch.id, p.correlation_matrix(df, names, digits=2), F.concat_ws("|", "x", "y"), F.col("value"))
    if ch.type == "scatter":
        return _series(ch.id, c.first_points(df, ch.x, ch.y, order_by), F.col("x"), F.col("y"))
    if ch.type == "roc":
        return _series(ch.id, roc_curve(df, ch.y, ch.x), F.col("fpr"), F.col("tpr"))
    if ch.type == "kpi" and ch.agg in SCORE_KPIS:
        return _series(ch.id, classification_metrics(df, ch.y, ch.x), F.lit(None), F.col(SCORE_KPIS[ch.agg]))
    if ch.agg == "missing_count":
        return _series(ch.id, c.missing_by_column(df), F.col("label"), F.col("value"))
    if ch.agg == "dtype_count":
        return _series(ch.id, c.dtype_counts(df), F.col("label"), F.col("value"))
    return None


def table_rows(df: DataFrame, ch: Chart, order_by: str, limit: int = 100) -> DataFrame:
    """First rows of a table chart, as text with nulls shown empty; only errors where asked."""
    rows = errors_only(df, ch.x, ch.y) if ch.agg == "errors_only" else df
    first = rows.orderBy(quoted(order_by)).limit(limit)
    return first.select(*[F.coalesce(quoted(n.name).cast("string"), F.lit("")).alias(n.name) for n in columns_of(df) if n.kind != "nested"])


def analysis(df: DataFrame, semantic: dict[str, str], filters: dict | None = None, datasets: int = 1) -> dict[str, DataFrame]:
    """Slicers, KPIs, trend, top-10 bar, insights and summary of a filtered table."""
    rows = slicer_filter(df, filters or {})
    numbers = [n for n in df.columns if semantic.get(n) in ("currency", "numeric", "count", "percentage")]
    categories = [n for n in df.columns if semantic.get(n) == "category"]
    dates = [n for n in df.columns if semantic.get(n) == "datetime"]
    out = {"slicers": slicer_options(rows), "kpis": c.auto_kpis(rows, semantic), "insights": p.data_insights(rows)}
    if dates and numbers:
        out["trend"] = c.monthly_trend(rows, dates[0], numbers[0])
    if categories and numbers:
        out["top"] = c.ranked_chart(rows, categories[0], numbers[0], "sum", "desc", 10)
    quality = p.quality_score(rows).select("quality_score").scalar()
    out["summary"] = rows.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"), F.lit(datasets).cast("bigint").alias("datasets"),
        quality.alias("data_quality"))
    return out


# Words of a question that lead to each kind of answer, in order.
TOPICS = (
    ("records", ("total", "count", "how many", "records")), ("quality", ("quality",)), ("issues", ("issue", "problem", "warning")),
    ("distribution", ("distribution", "breakdown")), ("metrics", ("metric", "kpi")), ("summary", ("summary", "finding", "summarize")),
)


def topic_of(question: str) -> str:
    asked = question.lower()
    return next((t for t, words in TOPICS if any(w in asked for w in words)), "default")


def answer_from_analysis(parts: dict[str, DataFrame], question: str) -> DataFrame:
    """(label, value): the part of a finished analysis a question asks for."""
    topic = topic_of(question)
    summary = parts["summary"]

    def facts(*names: str) -> DataFrame:
        return summary.select(F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("string").alias("value")) for n in names])))

    if topic == "records":
        return facts("total_rows", "datasets", "total_columns")
    if topic == "quality":
        return facts("data_quality")
    if topic == "issues":
        return parts["insights"].select(F.col("title").alias("label"), F.col("column").alias("value"))
    if topic == "distribution" and "top" in parts:
        return parts["top"].orderBy(F.col("value").desc(), "label").limit(5).select("label", F.col("value").cast("string").alias("value"))
    if topic == "metrics":
        return parts["kpis"].select(F.replace(F.lower("label"), F.lit(" "), F.lit("_")).alias("label"), F.col("value").cast("string").alias("value"))
    if topic == "summary":
        text = fill_template("{n} records analyzed, {d} dataset(s), data quality {q:.0f}%",
                             {"n": F.col("total_rows"), "d": F.col("datasets"), "q": F.col("data_quality")})
        return summary.select(F.lit("summary").alias("label"), text.alias("value")).unionByName(
            parts["kpis"].where(F.col("position") < 4).select("label", F.col("value").cast("string").alias("value")))
    return facts("total_rows", "data_quality")


def statistics(df: DataFrame, most: int | None = None) -> dict[str, DataFrame]:
    """Distributions of the numeric columns (all or the first ``most``), correlations and quality counts."""
    names = numeric_names(df)[:most]
    return {"distributions": p.distributions(df, names), "correlations": p.correlation_matrix(df, names), "strong": p.strong_correlations(df), "quality": p.overview(df)}


def business_sheets(txn: DataFrame, offerings: DataFrame, insights: DataFrame, start, end) -> dict[str, DataFrame]:
    """Overview, offering, loss and customer sheets of the star schema."""
    urgent = insights.where(F.col("severity").isin("critical", "high") & ~F.col("is_dismissed"))
    return {
        "kpis": k.kpis(txn, start, end), "trend": k.trend(txn, start, end, "month"),
        "alerts": urgent.orderBy("severity", "insight_type", "offering_id").limit(5).select("severity", F.col("title").alias("message")),
        "offerings": k.offering_metrics(txn, offerings, start, end).orderBy(F.col("revenue").desc(), "id"),
        "offering_summary": k.offering_summary(txn, offerings, start, end), "losses": k.loss_items(txn, offerings, start, end),
        "loss_summary": k.loss_summary(txn, offerings, start, end), "customers": k.retention(txn, start, end),
    }


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Share of every class of a target column."""
    total = df.agg(F.count(quoted(target))).scalar()
    return df.where(quoted(target).isNotNull()).groupBy(quoted(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count")).select(
        "label", "count", rounded(ratio(F.col("count"), total) * 100, 2).alias("percentage"))
