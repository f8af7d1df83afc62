"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import dashboards as b
from ledgerlens.operators import insights as i
from workload.business import FOUND
from workload.charts import ORACLES as CHART_SQL, ORDER_KINDS, histogram_sql
from workload.common import END, START, cte, r, table, view
from workload.kpi import ORACLES as KPI_SQL
from workload.profiling import ORACLES as PROFILE_SQL

SALES_SQL = """SELECT o_orderkey AS row, CAST(o_orderdate AS DATE) AS order_date, total_amount AS total, quantity, cost AS unit_cost, category, segment FROM (
SELECT o_orderkey, o_orderdate, l_extendedprice * (1 - l_discount) AS total_amount, l_quantity AS quantity, 1.9 * l_quantity * p_retailprice AS cost, p_brand AS category, c_mktsegment AS segment
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {customer} ON o_custkey = c_custkey)"""
NAMES = ("lineitem", "orders", "part", "customer")


def sales(s, d):
    return s.sql(SALES_SQL, **{n: table(s, d, n) for n in NAMES})


def orders(s, d):
    return table(s, d, "orders")


def spec(build, source):
    return lambda s, d: b.spec_table(source(s, d), build(source(s, d)))


def data(build, source, key):
    return lambda s, d: b.compile_charts(source(s, d), build(source(s, d)), key)


def binary(s, d):
    return view(s, d, "pred_binary")


def part_of(name):
    return lambda s, d: b.analysis(orders(s, d), ORDER_KINDS, {"o_orderstatus": ["F", "O"]})[name]


def sheets(s, d):
    txn, off = view(s, d, "txn"), view(s, d, "offering")
    return b.business_sheets(txn, off, i.evaluate_rules(i.rule_metrics(txn, off, START, END)), START, END)


def ask(question):
    return lambda s, d: b.answer_from_analysis(b.analysis(orders(s, d), ORDER_KINDS), question)


QUERIES = {
    "dashboard_spec_business": spec(b.business_charts, sales),
    "dashboard_spec_analytics": spec(b.analytics_charts, lambda s, d: table(s, d, "events")),
    "dashboard_spec_ml": spec(b.model_charts, binary),
    "dashboard_spec_science": spec(b.science_charts, binary),
    "dashboard_spec_general": spec(b.general_charts, orders),
    "sheet_sales": spec(lambda df: b.sheet_charts(df, "sales"), sales),
    "sheet_ml": spec(lambda df: b.sheet_charts(df, "ml"), binary),
    "sheet_generic": spec(lambda df: b.sheet_charts(df, "other"), orders),
    "charts_business": data(b.business_charts, sales, "row"),
    "charts_ml": data(b.model_charts, binary, "doc_id"),
    "charts_analytics": data(b.analytics_charts, lambda s, d: table(s, d, "events").drop("props"), "event_id"),
    "table_rows": lambda s, d: b.table_rows(view(s, d, "events_seeded").drop("ts", "value"), b.Chart("data", "t", "Data", "table"), "event_id"),
    "table_errors": lambda s, d: b.table_rows(binary(s, d).drop("probability"), b.Chart("e", "t", "E", "table", "predicted", "actual", "errors_only"), "doc_id"),
    "analysis_slicers": part_of("slicers"), "analysis_kpis": part_of("kpis"), "analysis_trend": part_of("trend"), "analysis_top": part_of("top"),
    "analysis_summary": part_of("summary"),
    "ask_records": ask("How many records are there?"), "ask_metrics": ask("What are the key metrics?"), "ask_distribution": ask("Show the distribution"),
    "ask_quality": ask("Are there any data quality issues?"), "ask_summary": ask("Summarize the findings"),
    "statistics": lambda s, d: b.statistics(view(s, d, "events_dirty"))["distributions"],
    "sheet_overview_alerts": lambda s, d: sheets(s, d)["alerts"],
    "sheet_offerings": lambda s, d: sheets(s, d)["offerings"],
    "class_balance": lambda s, d: b.class_balance(binary(s, d), "actual"),
}


def values(charts) -> str:
    def cell(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({n}, " + ", ".join(cell(v) for v in row) + ")" for n, row in enumerate(charts))
    return f"SELECT CAST(position AS INT) AS position, tab, id, title, type, CAST(x_column AS VARCHAR) AS x_column, CAST(y_column AS VARCHAR) AS y_column, CAST(aggregation AS VARCHAR) AS aggregation FROM (VALUES {rows}) v(position, tab, id, title, type, x_column, y_column, aggregation)"


SALES = "WITH s AS (" + SALES_SQL.format(**{n: n for n in NAMES}) + ")\n"
B = cte("pred_binary")
EVENT_NUMBERS = ("event_id", "user_id", "value")
TABLE = ("data", "data_table", "Raw Data", "table", None, None, None)


def grouped(ident: str, x: str, y: str, tab: str, limit: int | None = 20, month: bool = False, count: bool = False, agg: str = "sum") -> str:
    key = f"strftime(date_trunc('month', {x}), '%Y-%m')" if month else x
    value = "CAST(count(*) AS DOUBLE)" if count else r(f"{agg}({y})", 4)
    tail = f" ORDER BY value DESC, k LIMIT {limit}" if limit else ""
    return f"SELECT '{ident}' AS chart_id, CAST(k AS VARCHAR) AS label, value FROM (SELECT {key} AS k, {value} AS value FROM {tab} WHERE {x} IS NOT NULL GROUP BY 1{tail})"


def card(ident: str, value: str, tab: str) -> str:
    return f"SELECT '{ident}' AS chart_id, NULL AS label, CAST({value} AS DOUBLE) AS value FROM {tab}"


def hist(ident: str, col: str, tab: str) -> str:
    return f"""SELECT '{ident}' AS chart_id, printf('%.2f', {r('lower', 2)}) || '-' || printf('%.2f', {r('upper', 2)}) AS label, CAST(count AS DOUBLE) AS value
FROM (WITH src AS (SELECT CAST({col} AS DOUBLE) AS v FROM {tab}), e AS (SELECT min(v) AS lo, max(v) AS hi, 20 AS bins FROM src) {histogram_sql('')})"""


def box(ident: str, col: str, tab: str) -> str:
    q = (f"(SELECT min({col}) AS lo, max({col}) AS hi, quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.5) AS m, quantile_cont({col}, 0.75) AS b FROM {tab})")
    cells = {"min": "lo", "q1": "a", "median": "m", "q3": "b", "max": "hi", "lower_fence": "greatest(a - 1.5 * (b - a), lo)", "upper_fence": "least(b + 1.5 * (b - a), hi)"}
    return "\nUNION ALL ".join(f"SELECT '{ident}' AS chart_id, '{k}' AS label, {r(v, 4)} AS value FROM {q}" for k, v in cells.items())


_F1 = """(SELECT sum(f * s) / sum(s) * 100 FROM (SELECT s, 2.0::DOUBLE * tp / (s + q) AS f, tp / nullif(CAST(q AS DOUBLE), 0) AS p, tp / nullif(CAST(s AS DOUBLE), 0) AS rc FROM (
SELECT c, (SELECT count(*) FROM pred_binary WHERE actual = c) AS s, (SELECT count(*) FROM pred_binary WHERE predicted = c) AS q, (SELECT count(*) FROM pred_binary WHERE predicted = c AND actual = c) AS tp
FROM (SELECT DISTINCT actual AS c FROM pred_binary))))"""
_ROC = """(SELECT position, fp / n AS fpr, tp / p AS tpr FROM (SELECT row_number() OVER (ORDER BY score DESC) AS position, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp,
CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM (
SELECT probability AS score, count(CASE WHEN actual = 1 THEN 1 END) AS pos, count(CASE WHEN actual <> 1 THEN 1 END) AS neg FROM pred_binary GROUP BY 1)) UNION ALL SELECT 0, 0, 0)"""
FILTERED = "(SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O'))"


def on_filtered(sql: str) -> str:
    return sql.replace("FROM orders", f"FROM {FILTERED}")


_QUALITY = """(SELECT CAST(round(CAST(40 + (CAST(count(DISTINCT o_orderkey) AS DOUBLE) / count(*) * 100 + CAST(count(DISTINCT o_custkey) AS DOUBLE) / count(*) * 100) / 2 * 0.2
+ greatest(0, 100 - ((SELECT count(*) FROM T, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM T) WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a))
+ (SELECT count(*) FROM T, (SELECT quantile_cont(o_orderkey, 0.25) AS a, quantile_cont(o_orderkey, 0.75) AS b FROM T) WHERE o_orderkey < a - 1.5 * (b - a) OR o_orderkey > b + 1.5 * (b - a))
+ (SELECT count(*) FROM T, (SELECT quantile_cont(o_custkey, 0.25) AS a, quantile_cont(o_custkey, 0.75) AS b FROM T) WHERE o_custkey < a - 1.5 * (b - a) OR o_custkey > b + 1.5 * (b - a)))
/ CAST(count(*) * 6 AS DOUBLE) * 1000) * 0.2 + greatest(0, 100 - CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM T)) AS DOUBLE) / count(*) * 200) * 0.2 AS DECIMAL(38,5)), 1) AS DOUBLE) FROM T)"""

ORACLES = {
    "dashboard_spec_business": values([
        ("overview", "total_revenue", "Total Revenue", "kpi", None, "total", "sum"), ("overview", "total_profit", "Gross Profit", "kpi", None, "total-unit_cost", "calculated"),
        ("overview", "total_units", "Units Sold", "kpi", None, "quantity", "sum"), ("overview", "total_transactions", "Total Transactions", "kpi", None, None, "count"),
        ("overview", "revenue_trend", "Revenue Trend", "line", "order_date", "total", "sum"), ("overview", "revenue_by_category", "Revenue by category", "bar", "category", "total", "sum"),
        ("sales", "category_distribution", "Sales Distribution", "pie", "category", "total", "sum"), ("sales", "monthly_sales", "Monthly Sales Comparison", "month_bar", "order_date", "total", "sum"),
        ("sales", "top_performers", "Top Performers", "horizontal_bar", "category", "total", "sum"), TABLE]),
    "dashboard_spec_analytics": values([
        ("statistics", "total_records", "Total Records", "kpi", None, None, "count"), ("statistics", "total_columns", "Total Features", "kpi", None, None, "column_count"),
        ("statistics", "missing_pct", "Data Completeness", "kpi", None, None, "completeness"),
        *[("statistics", f"dist_{n}", f"Distribution: {n}", "histogram", n, None, None) for n in ("event_id", "user_id", "value")],
        *[("distributions", f"box_{n}", f"Box Plot: {n}", "boxplot", n, None, None) for n in ("event_id", "user_id", "value")],
        ("distributions", "cat_dist_event_type", "Distribution: event_type", "bar", "event_type", None, "count"),
        ("correlations", "correlation_matrix", "Correlation Matrix", "heatmap", "event_id,user_id,value", None, None),
        ("correlations", "scatter_1", "event_id vs user_id", "scatter", "event_id", "user_id", None),
        *[("time_series", f"trend_{n}", f"{n} Over Time", "line", "ts", n, "avg") for n in ("event_id", "user_id", "value")],
        ("quality", "missing_by_column", "Missing Values by Column", "bar", None, None, "missing_count"), ("quality", "data_types", "Data Type Distribution", "pie", None, None, "dtype_count"), TABLE]),
    "dashboard_spec_ml": values([
        ("overview", "sample_count", "Total Samples", "kpi", None, None, "count"), ("overview", "accuracy", "Accuracy", "gauge", "predicted", "actual", "accuracy"),
        ("overview", "confusion_matrix", "Confusion Matrix", "heatmap", "predicted", "actual", "confusion"), ("overview", "prediction_dist", "Prediction Distribution", "bar", "predicted", None, "count"),
        ("metrics", "precision", "Precision", "kpi", "predicted", "actual", "precision"), ("metrics", "recall", "Recall", "kpi", "predicted", "actual", "recall"),
        ("metrics", "f1_score", "F1 Score", "kpi", "predicted", "actual", "f1"), ("metrics", "roc_curve", "ROC Curve", "roc", "probability", "actual", None),
        ("metrics", "confidence_dist", "Confidence Distribution", "histogram", "probability", None, None),
        ("features", "feature_importance", "Feature Importance", "horizontal_bar", "doc_id", None, "feature_importance"), ("features", "feature_doc_id", "Feature: doc_id", "histogram", "doc_id", None, None),
        ("errors", "error_rate", "Error Rate", "kpi", "predicted", "actual", "error_rate"), ("errors", "misclassified", "Misclassified Samples", "table", "predicted", "actual", "errors_only"),
        ("predictions", "pred_table", "All Predictions", "table", None, None, None)]),
    "dashboard_spec_general": values([
        ("overview", "total_rows", "Total Records", "kpi", None, None, "count"), ("overview", "total_cols", "Total Columns", "kpi", None, None, "column_count"),
        ("overview", "num_dist", "Distribution: o_orderkey", "histogram", "o_orderkey", None, None), ("overview", "cat_dist", "Distribution: o_orderstatus", "bar", "o_orderstatus", None, "count"),
        ("data", "data_table", "Data", "table", None, None, None)]),
    "sheet_sales": values([
        ("overview", "total_revenue", "Total Revenue", "kpi", None, "total", "sum"), ("overview", "avg_order", "Avg Order Value", "kpi", None, "total", "avg"),
        ("overview", "total_records", "Total Records", "kpi", None, None, "count"), ("overview", "revenue_trend", "Revenue Trend", "line", "order_date", "total", "sum"),
        ("overview", "revenue_by_category", "Revenue by category", "bar", "category", "total", "sum"), ("overview", "category_distribution", "category Distribution", "pie", "category", None, "count"),
        ("details", "data_table", "Raw Data", "table", None, None, None)]),
    "sheet_ml": values([
        ("model_metrics", "sample_count", "Total Samples", "kpi", None, None, "count"), ("model_metrics", "prediction_dist", "Prediction Distribution", "bar", "predicted", None, "count"),
        ("model_metrics", "label_dist", "Label Distribution", "pie", "actual", None, "count"), ("model_metrics", "confidence_hist", "Confidence Distribution", "histogram", "probability", None, None)]),
    "sheet_generic": values([
        ("explorer", "total_records", "Total Records", "kpi", None, None, "count"), ("explorer", "cat_dist", "Distribution of o_orderstatus", "bar", "o_orderstatus", None, "count"),
        ("explorer", "time_trend", "Trend Over Time", "line", "o_orderdate", "o_totalprice", "sum"), ("explorer", "data_table", "Data Preview", "table", None, None, None)]),
    "charts_business": SALES + "\nUNION ALL ".join([
        card("total_revenue", r("sum(total)", 4), "s"), card("total_profit", r("sum(total) - sum(unit_cost)", 4), "s"), card("total_units", r("sum(quantity)", 4), "s"), card("total_transactions", "count(*)", "s"),
        grouped("revenue_trend", "order_date", "total", "s", None), grouped("monthly_sales", "order_date", "total", "s", None, True),
        *[grouped(n, "category", "total", "s", lim) for n, lim in (("revenue_by_category", 20), ("category_distribution", 20), ("top_performers", 10))]]),
    "charts_analytics": "\nUNION ALL ".join([
        card("total_records", "count(*)", "events"), card("total_columns", "5", "(SELECT 1)"),
        card("missing_pct", r("100 - CAST(count(*) * 5 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) AS DOUBLE) / (count(*) * 5) * 100", 2), "events"),
        *[hist(f"dist_{n}", n, "events") for n in EVENT_NUMBERS], *[box(f"box_{n}", n, "events") for n in EVENT_NUMBERS],
        grouped("cat_dist_event_type", "event_type", "*", "events", 20, count=True),
        *[f"SELECT 'correlation_matrix' AS chart_id, '{x}|{y}' AS label, {'1.0::DOUBLE' if x == y else r(f'corr({min(x, y)}, {max(x, y)})', 2)} AS value FROM {'(SELECT 1)' if x == y else 'events'}"
          for x in EVENT_NUMBERS for y in EVENT_NUMBERS],
        "SELECT 'scatter_1' AS chart_id, CAST(CAST(event_id AS DOUBLE) AS VARCHAR) AS label, CAST(user_id AS DOUBLE) AS value FROM (SELECT * FROM events ORDER BY event_id LIMIT 500)",
        *[f"SELECT 'trend_{n}' AS chart_id, strftime(ts, '%Y-%m-%d') AS label, {r(f'avg({n})', 4)} AS value FROM events WHERE ts IS NOT NULL GROUP BY 2" for n in EVENT_NUMBERS],
        *[f"SELECT 'missing_by_column' AS chart_id, '{n}' AS label, CAST(count(*) - count({n}) AS DOUBLE) AS value FROM events" for n in ("event_id", "ts", "user_id", "event_type", "value")],
        "SELECT 'data_types' AS chart_id, k AS label, CAST(n AS DOUBLE) AS value FROM (VALUES ('bigint', 2), ('timestamp_ntz', 1), ('string', 1), ('double', 1)) v(k, n)"]),
    "charts_ml": B + "\nUNION ALL ".join([
        card("sample_count", "count(*)", "pred_binary"), card("accuracy", r("CAST(count(CASE WHEN actual = predicted THEN 1 END) AS DOUBLE) / count(*) * 100", 4), "pred_binary"),
        card("error_rate", r("CAST(count(CASE WHEN actual <> predicted THEN 1 END) AS DOUBLE) / count(*) * 100", 4), "pred_binary"),
        grouped("prediction_dist", "predicted", "*", "pred_binary", 20, count=True),
        "SELECT 'confusion_matrix', p || '|' || a, CAST((SELECT count(*) FROM pred_binary WHERE actual = a AND predicted = p) AS DOUBLE) FROM (SELECT DISTINCT actual AS a FROM pred_binary), (SELECT DISTINCT actual AS p FROM pred_binary)",
        f"SELECT 'precision', NULL, {r(_F1.replace('sum(f * s)', 'sum(p * s)'), 2)}", f"SELECT 'recall', NULL, {r(_F1.replace('sum(f * s)', 'sum(rc * s)'), 2)}", f"SELECT 'f1_score', NULL, {r(_F1, 2)}",
        f"SELECT 'roc_curve', CAST({r('fpr', 6)} AS VARCHAR), {r('tpr', 6)} FROM {_ROC} WHERE position % greatest(1, (SELECT count(DISTINCT probability) + 1 FROM pred_binary) // 100) = 0",
        hist("confidence_dist", "probability", "pred_binary"), hist("feature_doc_id", "doc_id", "pred_binary")]),
    "table_rows": cte("events_seeded") + "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, coalesce(event_type, '') AS event_type FROM (SELECT * FROM events_seeded ORDER BY event_id LIMIT 100)",
    "table_errors": B + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(actual AS VARCHAR) AS actual, CAST(predicted AS VARCHAR) AS predicted FROM (SELECT * FROM pred_binary WHERE actual <> predicted ORDER BY doc_id LIMIT 100)",
    "analysis_slicers": "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS option FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 2",
    "analysis_kpis": on_filtered(CHART_SQL["auto_kpis"]),
    "analysis_trend": on_filtered(CHART_SQL["monthly_trend"]),
    "analysis_top": f"SELECT o_orderstatus AS label, {r('sum(o_totalprice)', 4)} AS value FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
    "analysis_summary": f"WITH T AS {FILTERED} SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns, CAST(1 AS BIGINT) AS datasets, {_QUALITY} AS data_quality FROM T",
    "ask_records": "SELECT 'total_rows' AS label, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'datasets', '1' UNION ALL SELECT 'total_columns', '6'",
    "sheet_overview_alerts": FOUND + "SELECT severity, title AS message FROM found WHERE severity IN ('critical', 'high') ORDER BY severity, insight_type, offering_id LIMIT 5",
    "dashboard_spec_science": values([
        ("statistics", "total_records", "Total Records", "kpi", None, None, "count"), ("statistics", "total_columns", "Total Features", "kpi", None, None, "column_count"),
        ("statistics", "missing_pct", "Data Completeness", "kpi", None, None, "completeness"),
        *[("statistics", f"dist_{n}", f"Distribution: {n}", "histogram", n, None, None) for n in ("doc_id", "actual", "predicted")],
        *[("distributions", f"box_{n}", f"Box Plot: {n}", "boxplot", n, None, None) for n in ("doc_id", "actual", "predicted", "probability")],
        ("modeling", "target_dist", "Target Distribution", "bar", "predicted", None, "count"), ("modeling", "target_balance", "Class Balance", "pie", "predicted", None, "count"),
        ("correlations", "correlation_matrix", "Correlation Matrix", "heatmap", "doc_id,actual,predicted,probability", None, None),
        ("correlations", "scatter_1", "doc_id vs actual", "scatter", "doc_id", "actual", None), ("correlations", "scatter_2", "predicted vs probability", "scatter", "predicted", "probability", None),
        ("quality", "missing_by_column", "Missing Values by Column", "bar", None, None, "missing_count"), ("quality", "data_types", "Data Type Distribution", "pie", None, None, "dtype_count"), TABLE]),
    "class_balance": B + f"SELECT CAST(actual AS VARCHAR) AS label, count(*) AS count, {r('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM pred_binary) * 100', 2)} AS percentage FROM pred_binary GROUP BY 1",
    "sheet_offerings": KPI_SQL["offering_metrics"],
    "statistics": PROFILE_SQL["distribution"].split("SELECT count(value)", 1)[0] + "\nUNION ALL ".join(
        "SELECT '" + c + "' AS \"column\", count(value)".replace("value", c) + PROFILE_SQL["distribution"].split("SELECT count(value)", 1)[1].replace("(value", f"({c}").replace(" value ", f" {c} ").replace("value <", f"{c} <").replace("value >", f"{c} >").replace("value,", f"{c},").replace("BY value", f"BY {c}")
        for c in ("event_id", "user_id", "value")),
}
