"""Star-schema queries."""

from __future__ import annotations

from ledgerlens.operators import kpis as k
from ledgerlens.plans.ordered import staged
from workload.common import END, PREV_END, PREV_START, START, cte, div, r, view

CUR = f"transaction_date BETWEEN DATE '{START}' AND DATE '{END}'"
PREV = f"transaction_date BETWEEN DATE '{PREV_START}' AND DATE '{PREV_END}'"


def txn(s, d):
    return view(s, d, "txn")


def off(s, d):
    return view(s, d, "offering")


def pos(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {div(a, b)} ELSE 0 END)"


def change(a: str, b: str, d: int = 2) -> str:
    return f"CASE WHEN {b} > 0 THEN {r(div(f'({a} - {b})', b), d)} END"


QUERIES = {
    "period_metrics": lambda s, d: k.period_metrics(txn(s, d), START, END),
    "kpi_overview": lambda s, d: k.kpis(txn(s, d), START, END),
    "trend_day": lambda s, d: k.trend(txn(s, d), START, END, "day"),
    "trend_week": lambda s, d: k.trend(txn(s, d), START, END, "week"),
    "trend_month": lambda s, d: k.trend(txn(s, d), START, END, "month"),
    "by_offering_type": lambda s, d: k.by_offering_type(txn(s, d), off(s, d), START, END),
    "offering_metrics": lambda s, d: k.offering_metrics(txn(s, d), off(s, d), START, END),
    "offering_summary": lambda s, d: k.offering_summary(txn(s, d), off(s, d), START, END),
    "customer_metrics": lambda s, d: k.customer_metrics(txn(s, d), view(s, d, "buyer"), START, END),
    "retention": lambda s, d: k.retention(txn(s, d), START, END),
    "loss_items": lambda s, d: k.loss_items(txn(s, d), off(s, d), START, END),
    "loss_summary": lambda s, d: k.loss_summary(txn(s, d), off(s, d), START, END),
    "top_offerings": lambda s, d: k.top_offerings(txn(s, d), off(s, d), START, END, 10, "revenue"),
    "top_offerings_profit": lambda s, d: k.top_offerings(txn(s, d), off(s, d), START, END, 10, "profit"),
    "bottom_offerings": lambda s, d: k.bottom_offerings(txn(s, d), off(s, d), START, END, 10),
    "metrics_daily": lambda s, d: k.daily_metrics(txn(s, d)),
    # from stored days: the weeks never see the transactions
    "weekly_merged": lambda s, d: k.merged_metrics(staged(k.daily_sketches(txn(s, d))), "week"),
    "top_customer_pct": lambda s, d: k.top_customer_share(txn(s, d)),
    "offering_trend": lambda s, d: k.offering_trend(txn(s, d), START, END),
    "stability": lambda s, d: k.stability(txn(s, d)),
}


def _trend_sql(unit: str) -> str:
    label = {"day": "strftime(period, '%Y-%m-%d')", "week": "strftime(period, 'W%W %Y')",
             "month": "strftime(period, '%b %Y')"}[unit]
    return cte("txn") + f"""SELECT period, {label} AS label, revenue, profit, cost FROM (
SELECT CAST(date_trunc('{unit}', transaction_date) AS DATE) AS period, {r('sum(total_amount)', 4)} AS revenue,
       {r('sum(profit)', 4)} AS profit, {r('sum(cost)', 4)} AS cost
FROM txn WHERE {CUR} GROUP BY 1) ORDER BY period"""


_WINDOWED = f"""SELECT sum(CASE WHEN {CUR} THEN total_amount ELSE 0 END) AS rc, sum(CASE WHEN {PREV} THEN total_amount ELSE 0 END) AS rp,
  sum(CASE WHEN {CUR} THEN profit ELSE 0 END) AS pc, sum(CASE WHEN {PREV} THEN profit ELSE 0 END) AS pp,
  sum(CASE WHEN {CUR} THEN cost ELSE 0 END) AS cc, count(CASE WHEN {CUR} THEN 1 END) AS nc,
  count(DISTINCT CASE WHEN {CUR} THEN customer_id END) AS uc, count(DISTINCT CASE WHEN {PREV} THEN customer_id END) AS up
FROM txn"""

_JOINED = f"FROM txn JOIN offering ON offering_id = id WHERE {CUR}"

ORACLES = {
    "period_metrics": cte("txn") + f"""SELECT {r('sum(total_amount)', 4)} AS revenue, {r('sum(profit)', 4)} AS profit,
{r('sum(cost)', 4)} AS cost, count(*) AS txn_count, count(DISTINCT customer_id) AS customers FROM txn WHERE {CUR}""",
    "kpi_overview": cte("txn") + f"""SELECT {r('rc', 4)} AS total_revenue, {r('pc', 4)} AS total_profit, {r('cc', 4)} AS total_cost,
{r(pos('pc', 'rc') + ' * 100', 2)} AS profit_margin, nc AS transaction_count, uc AS unique_customers,
{r(pos('rc', 'nc'), 2)} AS avg_order_value, {change('rc', 'rp')} AS revenue_trend, {change('pc', 'pp')} AS profit_trend,
{change('(pc / rc)', '(pp / rp)')} AS margin_trend, {change('uc', 'up')} AS customer_trend FROM ({_WINDOWED})""",
    "trend_day": _trend_sql("day"),
    "trend_week": _trend_sql("week"),
    "trend_month": _trend_sql("month"),
    "by_offering_type": cte("txn", "offering") + f"""SELECT coalesce(offering_type, 'Unknown') AS type, {r('sum(total_amount)', 4)} AS revenue,
{r('sum(profit)', 4)} AS profit, count(*) AS transactions {_JOINED} GROUP BY 1""",
    "offering_metrics": cte("txn", "offering") + f"""SELECT id, name, offering_type AS type, {r('sum(total_amount)', 4)} AS revenue,
{r('sum(profit)', 4)} AS profit, {r('sum(cost)', 4)} AS cost, {r(pos('sum(profit)', 'sum(total_amount)') + ' * 100', 2)} AS margin,
count(*) AS transactions, count(DISTINCT customer_id) AS customers {_JOINED} GROUP BY id, name, offering_type""",
    "offering_summary": cte("txn", "offering") + f"""SELECT count(*) AS total_offerings, count(CASE WHEN p > 0 THEN 1 END) AS profitable,
count(CASE WHEN p < 0 THEN 1 END) AS unprofitable FROM (SELECT id, sum(profit) AS p {_JOINED} GROUP BY id)""",
    "customer_metrics": cte("txn", "buyer") + f"""SELECT id, name, {r('sum(total_amount)', 4)} AS revenue, count(*) AS transactions,
min(transaction_date) AS first_transaction, max(transaction_date) AS last_transaction, count(*) > 1 AS is_repeat
FROM txn JOIN buyer ON customer_id = id WHERE {CUR} GROUP BY id, name""",
    "retention": cte("txn") + f"""SELECT count(customer_id) AS total_customers, count(CASE WHEN n > 1 THEN 1 END) AS repeat_customers,
count(CASE WHEN n = 1 THEN 1 END) AS one_time_customers, {r(pos('sum(rev)', 'count(customer_id)'), 2)} AS avg_revenue_per_customer,
{r(pos('count(CASE WHEN n > 1 THEN 1 END)', 'count(customer_id)') + ' * 100', 4)} AS retention_rate
FROM (SELECT customer_id, count(*) AS n, sum(total_amount) AS rev FROM txn WHERE {CUR} GROUP BY 1)""",
    "loss_items": cte("txn", "offering") + f"""SELECT id, name, offering_type AS type, {r('sum(profit)', 4)} AS loss, {r('sum(total_amount)', 4)} AS revenue,
{r('sum(cost)', 4)} AS cost, count(*) AS transactions {_JOINED} GROUP BY id, name, offering_type HAVING sum(profit) < 0""",
    "loss_summary": cte("txn", "offering") + f"""SELECT {r('abs(sum(p))', 4)} AS total_losses, count(*) AS loss_making_items
FROM (SELECT id, sum(profit) AS p {_JOINED} GROUP BY id HAVING sum(profit) < 0)""",
    "top_offerings": cte("txn", "offering") + f"""SELECT id, name, offering_type AS type, {r('sum(total_amount)', 4)} AS revenue, {r('sum(profit)', 4)} AS profit
{_JOINED} GROUP BY id, name, offering_type ORDER BY 4 DESC, id LIMIT 10""",
    "top_offerings_profit": cte("txn", "offering") + f"""SELECT id, name, offering_type AS type, {r('sum(total_amount)', 4)} AS revenue, {r('sum(profit)', 4)} AS profit
{_JOINED} GROUP BY id, name, offering_type ORDER BY 5 DESC, id LIMIT 10""",
    "bottom_offerings": cte("txn", "offering") + f"""SELECT id, name, offering_type AS type, {r('sum(total_amount)', 4)} AS revenue, {r('sum(profit)', 4)} AS profit,
{r('abs(sum(profit))', 4)} AS loss {_JOINED} GROUP BY id, name, offering_type HAVING sum(profit) < 0 ORDER BY 5, id LIMIT 10""",
    "weekly_merged": cte("txn") + f"""SELECT CAST(date_trunc('week', transaction_date) AS DATE) AS period_start, {r('sum(total_amount)', 4)} AS revenue, {r('sum(cost)', 4)} AS cost,
{r('sum(profit)', 4)} AS profit, count(*) AS transaction_count, count(DISTINCT customer_id) AS unique_customers FROM txn GROUP BY 1""",
    "metrics_daily": cte("txn") + f"""SELECT transaction_date AS metric_date, offering_id, {r('sum(total_amount)', 4)} AS revenue, {r('sum(cost)', 4)} AS cost,
{r('sum(profit)', 4)} AS profit, count(*) AS transaction_count, count(DISTINCT customer_id) AS unique_customers,
{r(pos('sum(total_amount)', 'count(*)'), 2)} AS avg_order_value FROM txn GROUP BY 1, 2""",
    "top_customer_pct": cte("txn") + f"""SELECT offering_id, {r(pos('max(rev)', 'sum(rev)') + ' * 100', 4)} AS top_customer_pct
FROM (SELECT offering_id, customer_id, sum(total_amount) AS rev FROM txn GROUP BY 1, 2) GROUP BY 1""",
    "offering_trend": cte("txn") + f"""SELECT offering_id, {change('rc', 'rp', 4)} AS revenue_trend,
CASE WHEN bp > 0 THEN {r(div(f"({div('bp', 'ap')} - coalesce({div('bc', 'ac')}, 0))", div('bp', 'ap')), 4)} END AS repeat_rate_decline
FROM (SELECT offering_id, sum(rc) AS rc, sum(rp) AS rp, count(CASE WHEN nc > 0 THEN 1 END) AS ac, count(CASE WHEN np > 0 THEN 1 END) AS ap,
count(CASE WHEN nc > 1 THEN 1 END) AS bc, count(CASE WHEN np > 1 THEN 1 END) AS bp FROM (
SELECT offering_id, customer_id, sum(CASE WHEN {CUR} THEN total_amount ELSE 0 END) AS rc, sum(CASE WHEN {PREV} THEN total_amount ELSE 0 END) AS rp,
count(CASE WHEN {CUR} THEN 1 END) AS nc, count(CASE WHEN {PREV} THEN 1 END) AS np FROM txn WHERE {CUR} OR {PREV} GROUP BY 1, 2) GROUP BY 1)""",
    "stability": cte("txn") + f"""SELECT offering_id, {r("CASE WHEN count(*) < 2 THEN 0.5 WHEN avg(rev) = 0 THEN 0 ELSE greatest(0, 1 - stddev_samp(rev) / avg(rev)) END", 2)} AS stability_score
FROM (SELECT offering_id, date_trunc('month', transaction_date) AS m, sum(total_amount) AS rev FROM txn GROUP BY 1, 2) GROUP BY 1""",
}
