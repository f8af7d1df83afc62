"""Offering, rule, insight and question queries."""

from __future__ import annotations

import re

from ledgerlens.operators import answers as a
from ledgerlens.operators import filters as f
from ledgerlens.operators import insights as i
from ledgerlens.operators import kpis as k
from ledgerlens.operators import offerings as o
from workload.common import END, PREV_END, PREV_START, START, cte, div, r, view
from workload.kpi import CUR, ORACLES as KPI_SQL, PREV, change, off, pos, txn


def metrics(s, d):
    return i.rule_metrics(txn(s, d), off(s, d), START, END)


def flat(df):
    return df.select("offering_id", "offering_name", "insight_type", "severity", "title", "description", "recommendation",
                     "expected_impact", "confidence", "evidence.*")


def found(s, d):
    return i.evaluate_rules(metrics(s, d))


def ask(kind):
    return lambda s, d: a.answer(kind, txn(s, d), off(s, d), START, END)


QUERIES = {
    "interval_regularity": lambda s, d: o.interval_regularity(txn(s, d)),
    "offering_signals": lambda s, d: o.offering_signals(txn(s, d)),
    "offering_type": lambda s, d: o.offering_types(o.offering_signals(txn(s, d)), off(s, d)),
    "offering_names": lambda s, d: o.offering_names(txn(s, d), off(s, d)),
    "rule_metrics": metrics,
    "rule_insights": lambda s, d: flat(found(s, d)),
    "insight_page": lambda s, d: f.insight_page(found(s, d), "high", None, 20, 15).select("offering_id", "insight_type", "severity", "title"),
    "insight_count": lambda s, d: f.insight_count(found(s, d), "critical"),
    "insight_dismiss": lambda s, d: f.insight_count(f.dismiss(found(s, d), f.F.col("insight_type") == "LOSS_001")),
    "merge_metrics": lambda s, d: i.merge_metrics(off(s, d).select("id", "name"), k.offering_metrics(txn(s, d), off(s, d), START, END)).select("id", "name", "revenue", "transactions"),
    "breakeven": lambda s, d: i.breakeven(k.offering_metrics(txn(s, d), off(s, d), START, END)),
    "risk_score": lambda s, d: i.risk_scores(metrics(s, d)),
    "loss_reason": lambda s, d: i.loss_reasons(k.offering_metrics(txn(s, d), off(s, d), START, END)),
    "high_margin": lambda s, d: f.high_margin(k.offering_metrics(txn(s, d), off(s, d), START, END)).select("id", "revenue", "profit"),
    "explain": lambda s, d: i.explain(found(s, d), metrics(s, d)),
    "executive_summary": lambda s, d: i.executive_summary(k.kpis(txn(s, d), START, END), found(s, d)),
    "answer_revenue": ask("revenue"), "answer_profit": ask("profit"), "answer_loss": ask("loss"), "answer_growth": ask("growth"),
    "answer_risk": ask("risk"), "answer_customer": ask("customer"), "answer_discontinue": ask("discontinue"),
    "answer_compare": ask("compare"), "answer_general": ask("anything"),
}


def sub(name: str) -> str:
    """An already checked KPI query as a subquery."""
    return f"({KPI_SQL[name]})"


_GAPS = """(SELECT offering_id, datediff('day', lag(transaction_date) OVER (PARTITION BY offering_id ORDER BY transaction_date), transaction_date) AS g FROM txn)"""
REGULAR = f"""SELECT offering_id, {r('avg(g)', 4)} AS mean_gap, {r('stddev_samp(g)', 4)} AS std_gap, CAST(floor(round(avg(g), 6)) AS BIGINT) AS avg_days_between,
coalesce(floor(round(stddev_samp(g), 6)) < 5, false) AS regular_interval FROM {_GAPS} WHERE g IS NOT NULL GROUP BY 1"""

SIGNALS = f"""SELECT b.offering_id, CASE WHEN ir > 0.9 THEN 'integer' ELSE 'decimal' END AS quantity_type, {r('aq', 4)} AS avg_quantity, {r('vq', 4)} AS quantity_variance,
{r('1 - ' + div('u', 'n'), 4)} AS repeat_ratio, 1 - {div('u', 'n')} > 0.1 AS has_repeat_customers, avg_days_between, coalesce(regular_interval, false) AS regular_interval,
{r('aa', 4)} AS avg_amount, {r('va', 2)} AS amount_variance, pr < 5 AS consistent_pricing
FROM (SELECT offering_id, avg(CASE WHEN quantity = floor(quantity) THEN 1.0::DOUBLE ELSE 0 END) AS ir, avg(quantity) AS aq, var_samp(quantity) AS vq, count(customer_id) AS n,
count(DISTINCT customer_id) AS u, avg(total_amount) AS aa, var_samp(total_amount) AS va, count(DISTINCT total_amount) AS pr FROM txn GROUP BY 1) b LEFT JOIN ({REGULAR}) g USING (offering_id)"""


def _type_sql() -> str:
    shown = {"integer_quantity": "quantity_type = 'integer'", "decimal_quantity": "quantity_type = 'decimal'", "time_based": "quantity_type = 'decimal'",
             "recurring_pattern": "regular_interval", "same_customer_multiple": "repeat_ratio > 0.3"}
    parts = []
    for n, (kind, words, patterns, weight) in enumerate(o.OFFERING_TYPES):
        named = " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN 1 ELSE 0 END" for w in words)
        seen = " + ".join(f"CASE WHEN {shown[p]} THEN 1 ELSE 0 END" for p in patterns if p in shown) or "0"
        parts.append(f"SELECT offering_id, name, {n} AS ord, '{kind}' AS kind, round((({named}) / {len(words)}.0::DOUBLE * 0.5 + ({seen}) / {len(patterns)}.0::DOUBLE * 0.5) * {weight}, 9) AS score FROM sn")
    return cte("txn", "offering").rstrip() + f",\nsn AS (SELECT s.*, name FROM ({SIGNALS}) s LEFT JOIN offering ON id = offering_id),\nsc AS (" + "\nUNION ALL ".join(parts) + f""")
SELECT offering_id, name, CASE WHEN score > 0.3 THEN kind ELSE 'physical_product' END AS type, CASE WHEN score > 0.3 THEN {r('least(score, 0.99)', 2)} ELSE 0.5 END AS confidence,
{r('score', 3)} AS best_score FROM sc QUALIFY row_number() OVER (PARTITION BY offering_id ORDER BY score DESC, ord) = 1"""


METRICS = f"""SELECT m.*, top_customer_pct, revenue_trend, repeat_rate_decline, stability_score
FROM {sub('offering_metrics')} m LEFT JOIN (SELECT offering_id, {r(pos('max(rev)', 'sum(rev)') + ' * 100', 4)} AS top_customer_pct
FROM (SELECT offering_id, customer_id, sum(total_amount) AS rev FROM txn WHERE {CUR} GROUP BY 1, 2) GROUP BY 1) t ON t.offering_id = id
LEFT JOIN {sub('offering_trend')} c ON c.offering_id = id
LEFT JOIN ({KPI_SQL['stability'].replace('FROM txn GROUP BY 1, 2', f'FROM txn WHERE {CUR} GROUP BY 1, 2')}) s ON s.offering_id = id"""
WITH_METRICS = cte("txn").rstrip() + f",\nmet AS ({METRICS})"


def fill_sql(template: str, cells: dict[str, str]) -> str:
    pieces = []
    for part in re.split(r"(\{[^}]*\})", template):
        if part.startswith("{"):
            name, _, spec = part[1:-1].partition(":")
            if not spec:
                pieces.append(f"coalesce(CAST({cells[name]} AS VARCHAR), '')")
            else:
                digits = int(spec.strip(",")[1:-1])
                value = r(cells[name], digits)
                pieces.append(f"format('{{:,.{digits}f}}', {value})" if spec.startswith(",") else f"printf('%.{digits}f', {value})")
        elif part:
            pieces.append("'" + part.replace("'", "''") + "'")
    return " || ".join(pieces)


BREAKEVEN = f"(CASE WHEN profit < 0 AND revenue > 0 THEN ({div('(revenue - profit)', 'revenue')} - 1) * 100 ELSE 0 END)"
CELLS = {
    "name": "name", "loss": "abs(profit)", "margin": "margin", "transactions": "transactions", "increase_pct": BREAKEVEN,
    "top_customer_pct": "top_customer_pct", "decline_pct": "abs(revenue_trend * 100)", "stability": "stability_score * 100",
    "potential_revenue": "revenue", "margin_gain": "revenue * 0.05::DOUBLE", "decline": "repeat_rate_decline * 100",
    "at_risk_revenue": "revenue * repeat_rate_decline",
}
FIRES = {
    "LOSS_001": "profit < 0", "LOSS_002": "margin > 0 AND margin < 5", "RISK_001": "top_customer_pct > 50", "RISK_002": "revenue_trend < -0.15",
    "RISK_003": "stability_score < 0.4", "GROWTH_001": "margin > 30 AND transactions < 50",
    "GROWTH_002": "transactions > 100 AND margin > 5 AND margin < 15", "CHURN_001": "repeat_rate_decline > 0.2",
}
FOUND = WITH_METRICS + ",\nfound AS (" + "\nUNION ALL ".join(
    f"""SELECT id AS offering_id, name AS offering_name, '{rule}' AS insight_type, '{severity}' AS severity, '{name}: ' || name AS title, '{text}' AS description,
{fill_sql(advice, CELLS)} AS recommendation, {fill_sql(impact, CELLS)} AS expected_impact, 0.95::DOUBLE AS confidence, revenue, profit, margin, transactions, top_customer_pct
FROM met WHERE {FIRES[rule]}""" for rule, name, text, severity, advice, impact in i.RULES) + ")\n"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'opportunity' THEN 4 ELSE 5 END"


def _explain_sql() -> str:
    cells = {"loss": "abs(profit)", "revenue": "revenue", "cost": "revenue - profit", "margin": "margin", "transactions": "transactions",
             "top_customer_pct": "top_customer_pct", "description": "title", "recommendation": "recommendation",
             "expected_impact": "'Improve business performance.'",
             "evidence_summary": "concat_ws(chr(10), CASE WHEN revenue <> 0 THEN " + fill_sql("- Revenue: ${v:,.2f}", {"v": "revenue"})
             + " END, CASE WHEN profit <> 0 THEN " + fill_sql("- Profit: ${v:,.2f}", {"v": "profit"}) + " END, CASE WHEN margin <> 0 THEN "
             + fill_sql("- Margin: {v:.1f}%", {"v": "margin"}) + " END, CASE WHEN transactions <> 0 THEN "
             + fill_sql("- Transactions: {v:,.0f}", {"v": "transactions"}) + " END)"}
    whens = " ".join(f"WHEN '{n}' THEN {fill_sql(t, cells)}" for n, t in i.EXPLANATIONS.items() if n != "default")
    return FOUND + f"SELECT offering_id, insight_type, CASE insight_type {whens} ELSE {fill_sql(i.EXPLANATIONS['default'], cells)} END AS explanation FROM found"


def _titles(condition: str, n: int) -> str:
    return f"(SELECT string_agg('- ' || title || chr(10), '' ORDER BY rk, insight_type, offering_id) FROM (SELECT *, {RANK} AS rk FROM found WHERE {condition} ORDER BY rk, insight_type, offering_id LIMIT {n}))"


_URGENT = "severity IN ('critical', 'high')"
SUMMARY = FOUND + f"""SELECT {fill_sql('**Performance Summary for this period:**' + chr(10) + 'Total revenue was ${r:,.2f} with a profit of ${p:,.2f} ({m:.1f}% margin).' + chr(10),
                                   {'r': 'total_revenue', 'p': 'total_profit', 'm': 'profit_margin'})}
|| CASE WHEN revenue_trend > 0.1 THEN {fill_sql('📈 Revenue grew {t:.0f}% compared to the previous period.' + chr(10), {'t': 'revenue_trend * 100'})}
WHEN revenue_trend < -0.1 THEN {fill_sql('📉 Revenue declined {t:.0f}% compared to the previous period.' + chr(10), {'t': 'abs(revenue_trend) * 100'})}
WHEN revenue_trend IS NOT NULL THEN '📊 Revenue remained relatively stable.' || chr(10) ELSE '' END
|| coalesce((SELECT chr(10) || '**⚠️ ' || count(*) || ' critical/high-priority items require attention:**' || chr(10) FROM found WHERE {_URGENT} HAVING count(*) > 0) || {_titles(_URGENT, 3)}, '')
|| coalesce((SELECT chr(10) || '**💡 ' || count(*) || ' growth opportunities identified:**' || chr(10) FROM found WHERE severity = 'opportunity' HAVING count(*) > 0) || {_titles("severity = 'opportunity'", 2)}, '') AS summary
FROM {sub('kpi_overview')}"""

H = sub("kpi_overview")
TOP5 = sub("top_offerings").replace("LIMIT 10", "LIMIT 5")
BEST5 = sub("top_offerings_profit").replace("LIMIT 10", "LIMIT 5")
WORST = sub("bottom_offerings").replace("LIMIT 10", "")
LOST = sub("loss_summary")
ALL_BEST = sub("top_offerings_profit").replace("LIMIT 10", "")
REASON = f"CASE WHEN revenue = 0 THEN '{i.NO_REVENUE}' WHEN revenue - profit > revenue * 2 THEN '{i.FAR_ABOVE}' WHEN revenue - profit > revenue THEN '{i.ABOVE}' ELSE '{i.UNCLEAR}' END"
_PREV_H = (H.replace(PREV, "@P@").replace(CUR, "@C@")
           .replace("@C@", f"transaction_date BETWEEN DATE '{PREV_START}' AND DATE '{PREV_END}'")
           .replace("@P@", "transaction_date BETWEEN DATE '1997-12-30' AND DATE '1998-12-30'"))


def _period(name, inner, start, end):
    return (f"SELECT '{name}' AS period, '{start}' AS start, '{end}' AS \"end\", total_revenue AS revenue, total_profit AS profit, profit_margin AS margin, "
            f"revenue_trend AS revenue_change, profit_trend AS profit_change FROM {inner}")


ORACLES = {
    "interval_regularity": cte("txn") + REGULAR,
    "offering_signals": cte("txn") + SIGNALS,
    "offering_type": _type_sql(),
    "offering_names": cte("txn", "offering") + "SELECT offering_id, any_value(name) AS name, count(*) AS transactions FROM txn LEFT JOIN offering ON id = offering_id GROUP BY 1",
    "rule_metrics": WITH_METRICS + "\nSELECT * FROM met",
    "rule_insights": FOUND + "SELECT * EXCLUDE (top_customer_pct) FROM found",
    "insight_page": FOUND + f"SELECT offering_id, insight_type, severity, title FROM found WHERE severity = 'high' ORDER BY {RANK}, insight_type, offering_id LIMIT 15 OFFSET 20",
    "insight_count": FOUND + "SELECT count(*) AS total FROM found WHERE severity = 'critical'",
    "insight_dismiss": FOUND + "SELECT count(*) AS total FROM found WHERE insight_type <> 'LOSS_001'",
    "merge_metrics": cte("offering") + f"SELECT o.id, o.name, m.revenue, m.transactions FROM offering o LEFT JOIN {sub('offering_metrics')} m ON m.id = o.id",
    "breakeven": f"SELECT id, {r(BREAKEVEN, 4)} AS increase_pct FROM {sub('offering_metrics')}",
    "risk_score": WITH_METRICS + f"""\nSELECT id, {r('''(CASE WHEN margin < 0 THEN 0.9::DOUBLE WHEN margin < 10 THEN 0.6 WHEN margin < 20 THEN 0.3 ELSE 0.1 END + (1 - stability_score)
+ CASE WHEN top_customer_pct > 50 THEN 0.8::DOUBLE WHEN top_customer_pct > 30 THEN 0.5 ELSE 0.2 END
+ CASE WHEN coalesce(revenue_trend, 0) < -0.2 THEN 0.9::DOUBLE WHEN coalesce(revenue_trend, 0) < -0.1 THEN 0.6 WHEN coalesce(revenue_trend, 0) < 0 THEN 0.3 ELSE 0.1 END) / 4''', 2)} AS risk_score FROM met""",
    "loss_reason": f"SELECT id, name, {r('abs(profit)', 4)} AS loss, {REASON} AS reason FROM {sub('offering_metrics')} WHERE profit < 0",
    "high_margin": f"SELECT id, revenue, profit FROM {sub('offering_metrics')} WHERE revenue > 0 AND profit / revenue > 0.2",
    "explain": _explain_sql(),
    "executive_summary": SUMMARY,
    "answer_revenue": f"SELECT t.id, t.name, t.revenue, t.profit, total_revenue, revenue_trend AS trend, {fill_sql('Your total revenue for the period is ${v:,.2f}.', {'v': 'total_revenue'})} AS summary FROM {TOP5} t, {H} h",
    "answer_profit": f"""SELECT t.id, t.name, t.revenue, t.profit, total_profit, profit_margin, profit_trend AS trend,
{fill_sql('Your total profit is ${p:,.2f} with a {m:.1f}% margin.', {'p': 'total_profit', 'm': 'profit_margin'})} AS summary FROM {BEST5} t, {H} h""",
    "answer_loss": f"""SELECT id, name AS offering, loss, {REASON} AS reason, total_losses AS total_loss,
{fill_sql('You are losing ${v:,.2f} across {n} offerings.', {'v': 'total_losses', 'n': 'loss_making_items'})} AS summary FROM {WORST} w, {LOST} t ORDER BY profit, id LIMIT 5""",
    "answer_growth": f"""SELECT id, name, type, revenue, profit, 'Focus on your highest-margin offerings with growth potential.' AS summary FROM {ALL_BEST}
WHERE revenue > 0 AND profit / revenue > 0.2 ORDER BY profit DESC, id LIMIT 5""",
    "answer_risk": f"""SELECT id, name AS offering, 'Negative profit margin' AS risk_factors, 'Review pricing or discontinue' AS recommendation,
loss_making_items || ' offerings show risk indicators.' AS summary FROM {WORST} w, {LOST} t ORDER BY profit, id LIMIT 5""",
    "answer_customer": f"""SELECT unique_customers AS total_customers, {r(pos('total_revenue', 'unique_customers'), 2)} AS avg_revenue_per_customer, transaction_count AS total_transactions,
{fill_sql('You have {n} customers with average revenue of ${v:,.2f} per customer.', {'n': 'unique_customers', 'v': pos('total_revenue', 'unique_customers')})} AS summary FROM {H}""",
    "answer_discontinue": f"""WITH w AS (SELECT * FROM {WORST} WHERE loss > 500) SELECT id, name AS offering, loss, CASE WHEN loss > 1000 THEN 'Consider discontinuing' ELSE 'Review pricing' END AS recommendation,
(SELECT count(*) FROM w) || ' offerings are candidates for discontinuation or major revision.' AS summary FROM w ORDER BY profit, id LIMIT 5""",
    "answer_compare": _period("current", H, START, END) + " UNION ALL " + _period("previous", _PREV_H, PREV_START, PREV_END),
    "answer_general": f"""SELECT total_revenue AS revenue, total_profit AS profit, profit_margin AS margin, unique_customers AS customers, transaction_count AS transactions,
'Here''s an overview of your business performance:' AS summary FROM {H}""",
}
