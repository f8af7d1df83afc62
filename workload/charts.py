"""Filter and chart queries."""

from __future__ import annotations

from ledgerlens.operators import charts as c
from ledgerlens.operators import filters as f
from workload.common import END, START, cte, div, r, table, view


def t(name):
    return lambda s, d: table(s, d, name)


orders, events, lineitem = t("orders"), t("events"), t("lineitem")

ORDER_KINDS = {"o_orderkey": "identifier", "o_custkey": "identifier", "o_totalprice": "currency",
               "o_orderdate": "datetime", "o_orderstatus": "category"}

CARDS = [
    {"id": "orders", "agg": "count"}, {"id": "customers", "agg": "count_distinct", "x": "o_custkey"},
    {"id": "columns", "agg": "column_count"}, {"id": "filled", "agg": "completeness", "format": "percent"},
    {"id": "total", "agg": "sum", "y": "o_totalprice", "format": "currency"},
    {"id": "average", "agg": "avg", "y": "o_totalprice", "format": "currency"},
    {"id": "per_customer", "agg": "avg_per_group", "x": "o_custkey", "y": "o_totalprice", "format": "currency"},
]

QUERIES = {
    "slicer_filter": lambda s, d: f.slicer_filter(orders(s, d), {"o_orderstatus": ["F", "O"], "o_custkey": [1, 2, 3], "nope": 1}),
    "chart_filter": lambda s, d: f.chart_filter(orders(s, d), {"o_orderstatus": "F", "o_custkey": [1, 2, 3, 4, 5]}),
    "date_range_filter": lambda s, d: f.chart_filter(orders(s, d), {}).where(
        f"o_orderdate >= timestamp_ntz '{START}' and o_orderdate < timestamp_ntz '2001-01-01'").groupBy("o_orderstatus").count(),
    "slicer_options": lambda s, d: f.slicer_options(view(s, d, "events_dirty")),
    "global_filters": lambda s, d: f.global_filters(orders(s, d)),
    "column_kinds": lambda s, d: f.column_kinds(orders(s, d)),
    "chart_sum": lambda s, d: c.ranked_chart(orders(s, d), "o_orderpriority", "o_totalprice", "sum"),
    "chart_avg": lambda s, d: c.ranked_chart(orders(s, d), "o_orderpriority", "o_totalprice", "avg"),
    "chart_min": lambda s, d: c.ranked_chart(orders(s, d), "o_orderstatus", "o_totalprice", "min", "asc"),
    "chart_max": lambda s, d: c.ranked_chart(orders(s, d), "o_custkey", "o_totalprice", "max", "desc", 20),
    "chart_count": lambda s, d: c.ranked_chart(view(s, d, "events_dirty"), "event_type"),
    "chart_unknown_agg": lambda s, d: c.ranked_chart(orders(s, d), "o_custkey", "o_totalprice", "spread", "desc", 10),
    "custom_chart": lambda s, d: c.custom_chart(orders(s, d), "o_orderdate", "o_totalprice", "sum"),
    "custom_chart_counts": lambda s, d: c.custom_chart(orders(s, d), "o_custkey"),
    "time_chart": lambda s, d: c.time_chart(orders(s, d), "o_orderdate", "o_totalprice"),
    "value_counts": lambda s, d: c.value_counts(view(s, d, "events_dirty"), "event_type", 10),
    "kpi_cards": lambda s, d: c.kpi_cards(orders(s, d), CARDS),
    "kpi_calculated": lambda s, d: c.kpi_cards(view(s, d, "txn"), [
        {"id": "gross", "agg": "calculated", "y": "total_amount-cost", "format": "currency"}]),
    "auto_kpis": lambda s, d: c.auto_kpis(orders(s, d), ORDER_KINDS),
    "financial_metrics": lambda s, d: c.financial_metrics(view(s, d, "txn").select("quantity", "total_amount", "cost", "unit_price")),
    "monthly_growth": lambda s, d: c.monthly_growth(orders(s, d), "o_orderdate", "o_totalprice"),
    "monthly_trend": lambda s, d: c.monthly_trend(orders(s, d), "o_orderdate", "o_totalprice"),
    "daily_resample": lambda s, d: c.daily_series(orders(s, d), "o_orderdate", "o_totalprice"),
    "missing_by_column": lambda s, d: c.missing_by_column(view(s, d, "events_dirty")),
    "dtype_counts": lambda s, d: c.dtype_counts(lineitem(s, d)),
    "histogram20": lambda s, d: c.histogram(lineitem(s, d), "l_extendedprice"),
    "histogram_auto": lambda s, d: c.histogram(events(s, d), "value", None),
    "boxplot": lambda s, d: c.boxplot(lineitem(s, d), "l_extendedprice"),
    "boxplot_by_group": lambda s, d: c.boxplot_by_group(lineitem(s, d), ["l_returnflag", "l_linestatus"], "l_extendedprice"),
    "boxplot_outliers": lambda s, d: c.boxplot_outliers(events(s, d), "value", "event_id"),
    "scatter_points": lambda s, d: c.first_points(view(s, d, "events_dirty").distinct(), "user_id", "value", "event_id"),
    "scatter_sample": lambda s, d: c.scatter(events(s, d), "user_id", "value", "event_id"),
}


def _chart(tab: str, x: str, y: str, agg: str, order: str, limit: int) -> str:
    value = "CAST(count(*) AS DOUBLE)" if y == "*" else r(f"{agg}({y})", 4)
    return f"""SELECT CAST({x} AS VARCHAR) AS label, value FROM (SELECT {x}, {value} AS value FROM {tab}
WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY {order} LIMIT {limit})"""


def _options(cols) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(v AS VARCHAR) AS option FROM (SELECT DISTINCT {c} AS v FROM events_dirty WHERE {c} IS NOT NULL)
WHERE (SELECT count(DISTINCT {c}) FROM events_dirty) BETWEEN 2 AND 49""" for c in cols)


def money(v: str) -> str:
    return f"""CASE WHEN {v} >= 1000000 THEN '$' || printf('%.1f', {v} / 1000000) || 'M'
WHEN {v} >= 1000 THEN '$' || printf('%.1f', {v} / 1000) || 'K' ELSE '$' || printf('%.2f', {v}) END"""


def histogram_sql(source: str, bins: str = "20") -> str:
    return f"""SELECT CAST(i AS INT) AS bin, {r('lo + i * (hi - lo) / bins', 4)} AS lower, {r('lo + (i + 1) * (hi - lo) / bins', 4)} AS upper,
count(v) AS count FROM (SELECT lo, hi, bins, unnest(range(CAST(bins AS BIGINT))) AS i FROM e)
LEFT JOIN (SELECT v, least(CAST(floor((v - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS b FROM src, e) ON b = i
GROUP BY i, lo, hi, bins"""


def _with_edges(col: str, tab: str, bins: str) -> str:
    return f"WITH src AS (SELECT {col} AS v FROM {tab} WHERE {col} IS NOT NULL),\ne AS (SELECT min(v) AS lo, max(v) AS hi, {bins} AS bins FROM src)\n"


_STURGES = "(max(v) - min(v)) / (log2(count(v)) + 1)"
_FD = "2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / cbrt(count(v))"
_AUTO = f"""CAST(ceil(round((max(v) - min(v)) / CASE WHEN {_FD} > 0 THEN least({_FD}, {_STURGES}) ELSE {_STURGES} END, 9)) AS BIGINT)"""

ORACLES = {
    "slicer_filter": "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND CAST(o_custkey AS VARCHAR) IN ('1', '2', '3')",
    "chart_filter": "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (1, 2, 3, 4, 5)",
    "date_range_filter": f"SELECT o_orderstatus, count(*) AS count FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1",
    "slicer_options": cte("events_dirty") + _options(["event_id", "user_id", "event_type", "value"]) + """
UNION ALL SELECT 'ts', CAST(v AS VARCHAR) FROM (SELECT DISTINCT ts AS v FROM events_dirty) WHERE (SELECT count(DISTINCT ts) FROM events_dirty) BETWEEN 2 AND 49""",
    "global_filters": """SELECT CAST(2 AS INT) AS ordinal, 'o_orderstatus' AS "column", 'O Orderstatus' AS label, 'multi_select' AS type FROM orders HAVING count(DISTINCT o_orderstatus) < 20
UNION ALL SELECT CAST(4 AS INT), 'o_orderdate', 'O Orderdate', 'date_range'
UNION ALL SELECT CAST(5 AS INT), 'o_orderpriority', 'O Orderpriority', 'multi_select' FROM orders HAVING count(DISTINCT o_orderpriority) < 20""",
    "column_kinds": """SELECT CAST(o AS INT) AS ordinal, c AS "column", g AS "group" FROM (VALUES (0, 'o_orderkey', 'numeric'), (1, 'o_custkey', 'numeric'),
(3, 'o_totalprice', 'numeric'), (4, 'o_orderdate', 'datetime')) v(o, c, g)
UNION ALL SELECT CAST(2 AS INT), 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) < 50 THEN 'categorical' ELSE 'text' END FROM orders
UNION ALL SELECT CAST(5 AS INT), 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) < 50 THEN 'categorical' ELSE 'text' END FROM orders""",
    "chart_sum": _chart("orders", "o_orderpriority", "o_totalprice", "sum", "2 DESC, 1", 20),
    "chart_avg": _chart("orders", "o_orderpriority", "o_totalprice", "avg", "2 DESC, 1", 20),
    "chart_min": _chart("orders", "o_orderstatus", "o_totalprice", "min", "2, 1", 20),
    "chart_max": _chart("orders", "o_custkey", "o_totalprice", "max", "2 DESC, 1", 20),
    "chart_count": cte("events_dirty") + _chart("events_dirty", "event_type", "*", "count", "2 DESC, 1", 20),
    "chart_unknown_agg": _chart("orders", "o_custkey", "o_totalprice", "sum", "2 DESC, 1", 10),
    "custom_chart": _chart("orders", "o_orderdate", "o_totalprice", "sum", "1", 20),
    "custom_chart_counts": _chart("orders", "o_custkey", "*", "count", "2 DESC, 1", 20),
    "time_chart": f"SELECT o_orderdate AS label, {r('sum(o_totalprice)', 4)} AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1",
    "value_counts": cte("events_dirty") + f"""SELECT event_type AS value, count(*) AS count, {r(div('count(*)', '(SELECT count(*) FROM events_dirty)') + ' * 100', 2)} AS percentage
FROM events_dirty WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "kpi_cards": f"""WITH k AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS u, {r('sum(o_totalprice)', 4)} AS t, {r('avg(o_totalprice)', 4)} AS a,
{r(div('sum(o_totalprice)', 'count(DISTINCT o_custkey)'), 4)} AS p,
{r(div('(count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority))', '(count(*) * 6)') + ' * 100', 4)} AS f FROM orders)
SELECT 'orders' AS id, n AS value, format('{{:,}}', CAST(n AS BIGINT)) AS text FROM k UNION ALL SELECT 'customers', u, format('{{:,}}', CAST(u AS BIGINT)) FROM k
UNION ALL SELECT 'columns', 6.0::DOUBLE, '6' FROM k UNION ALL SELECT 'filled', f, printf('%.1f', f) || '%' FROM k
UNION ALL SELECT 'total', t, {money('t')} FROM k UNION ALL SELECT 'average', a, {money('a')} FROM k UNION ALL SELECT 'per_customer', p, {money('p')} FROM k""",
    "kpi_calculated": cte("txn") + f"SELECT 'gross' AS id, v AS value, {money('v')} AS text FROM (SELECT {r('sum(total_amount) - sum(cost)', 4)} AS v FROM txn)",
    "auto_kpis": f"""SELECT CAST(0 AS INT) AS position, 'Total O Totalprice' AS label, {r('sum(o_totalprice)', 4)} AS value, 'currency' AS format, 'o_totalprice' AS "column" FROM orders
UNION ALL SELECT CAST(1 AS INT), 'Avg O Totalprice', {r('avg(o_totalprice)', 4)}, 'currency', 'o_totalprice' FROM orders
UNION ALL SELECT CAST(2 AS INT), 'Total Records', CAST(count(*) AS DOUBLE), 'number', NULL FROM orders""",
    "financial_metrics": cte("txn") + f"""SELECT {r('sum(total_amount)', 2)} AS revenue_total, {r('avg(total_amount)', 2)} AS revenue_average, {r('min(total_amount)', 2)} AS revenue_min,
{r('max(total_amount)', 2)} AS revenue_max, {r('stddev_samp(total_amount)', 2)} AS revenue_std, {r('median(total_amount)', 2)} AS revenue_median,
{r('sum(cost)', 2)} AS cost_total, {r('avg(cost)', 2)} AS cost_average, {r('sum(total_amount) - sum(cost)', 2)} AS gross_profit,
{r('(sum(total_amount) - sum(cost)) / sum(total_amount) * 100', 2)} AS profit_margin, {r('sum(cost) / sum(total_amount) * 100', 2)} AS cost_ratio,
CAST(sum(quantity) AS BIGINT) AS volume_total, {r('avg(quantity)', 2)} AS volume_average FROM txn""",
    "monthly_growth": f"""WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1),
w AS (SELECT v, lag(v) OVER (ORDER BY m) AS p FROM m QUALIFY row_number() OVER (ORDER BY m DESC) = 1)
SELECT {r('(v - p) / p * 100', 2)} AS monthly_growth_rate, CASE WHEN v > p THEN 'increasing' WHEN v < p THEN 'decreasing' ELSE 'stable' END AS trend FROM w""",
    "monthly_trend": f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {r('sum(o_totalprice)', 4)} AS value FROM orders GROUP BY 1",
    "daily_resample": f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1),
b AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT day, {r('coalesce(v, 0)', 4)} AS value FROM b LEFT JOIN d USING (day) ORDER BY day DESC LIMIT 100""",
    "missing_by_column": cte("events_dirty") + "\nUNION ALL ".join(
        f"SELECT '{x}' AS label, count(*) - count({x}) AS value FROM events_dirty" for x in ("event_id", "ts", "user_id", "event_type", "value")),
    "dtype_counts": """SELECT CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS label,
count(*) AS value FROM duckdb_columns() WHERE table_name = 'lineitem' GROUP BY 1""",
    "histogram20": _with_edges("l_extendedprice", "lineitem", "20") + histogram_sql("lineitem"),
    "histogram_auto": _with_edges("value", "events", _AUTO) + histogram_sql("events"),
    "boxplot_by_group": f"""WITH q AS (SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS lo, quantile_cont(l_extendedprice, 0.25) AS a, median(l_extendedprice) AS m,
quantile_cont(l_extendedprice, 0.75) AS b, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, {r('lo', 4)} AS min, {r('a', 4)} AS q1, {r('m', 4)} AS median, {r('b', 4)} AS q3, {r('hi', 4)} AS max,
{r('greatest(a - 1.5 * (b - a), lo)', 4)} AS lower_fence, {r('least(b + 1.5 * (b - a), hi)', 4)} AS upper_fence FROM q""",
    "boxplot": f"""WITH q AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.25) AS a,
quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT {r('lo', 4)} AS min, {r('a', 4)} AS q1, {r('m', 4)} AS median, {r('b', 4)} AS q3, {r('hi', 4)} AS max,
{r('greatest(a - 1.5 * (b - a), lo)', 4)} AS lower_fence, {r('least(b + 1.5 * (b - a), hi)', 4)} AS upper_fence FROM q""",
    "boxplot_outliers": """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) ORDER BY event_id LIMIT 50""",
    "scatter_sample": """SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL
ORDER BY md5(CAST(event_id AS VARCHAR)), 1, 2 LIMIT 500""",
    "scatter_points": cte("events_dirty") + """SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM (SELECT DISTINCT * FROM events_dirty)
WHERE user_id IS NOT NULL AND value IS NOT NULL ORDER BY event_id LIMIT 500""",
}
