"""Business rules over offering metrics, and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.dates import as_date, period_start, previous_window
from ledgerlens.functions.numbers import ratio, ratio_or, rounded
from ledgerlens.functions.text import fill_template
from ledgerlens.operators import kpis as k
from ledgerlens.operators.filters import severity_rank

# Rule id, name, description, severity, recommendation and expected impact.
RULES = (
    ("LOSS_001", "Negative Profit Offering", "Offering is generating losses", "critical",
     "Review pricing or discontinue '{name}'. Current loss: ${loss:.2f}. Consider increasing price by {increase_pct:.0f}% to break even.",
     "Eliminate ${loss:.2f} in annual losses"),
    ("LOSS_002", "Low Margin Offering", "Offering has very low profit margin", "high",
     "'{name}' has only {margin:.1f}% margin. Consider price increase or cost reduction.",
     "Improve margin from {margin:.1f}% to target 15%"),
    ("RISK_001", "High Customer Concentration", "Revenue concentrated in few customers", "high",
     "'{name}' has {top_customer_pct:.0f}% revenue from top customer. Diversify customer base.", "Reduce dependency risk"),
    ("RISK_002", "Declining Revenue Trend", "Offering showing declining revenue", "high",
     "'{name}' revenue declined {decline_pct:.0f}%. Investigate cause and consider intervention.", "Stabilize or reverse declining trend"),
    ("RISK_003", "High Volatility", "Offering has unstable revenue", "medium",
     "'{name}' has unstable revenue (stability: {stability:.0f}%). Consider subscription model or contracts.", "Improve revenue predictability"),
    ("GROWTH_001", "High Margin Low Volume", "Profitable offering with growth potential", "opportunity",
     "'{name}' has {margin:.0f}% margin but only {transactions} sales. Increase marketing investment.",
     "Potential ${potential_revenue:.2f} additional revenue with 2x volume"),
    ("GROWTH_002", "High Volume Low Margin", "Popular offering with margin improvement opportunity", "opportunity",
     "'{name}' is popular ({transactions} sales) but has only {margin:.0f}% margin. Small price increase could significantly improve profit.",
     "${margin_gain:.2f} additional profit with 5% price increase"),
    ("CHURN_001", "Customer Churn Risk", "Customers showing reduced activity", "medium",
     "Customer repeat rate declined {decline:.0f}%. Implement retention program.", "Retain at-risk customers worth ${at_risk_revenue:.2f}"),
)
CONFIDENCE = 0.95
# Wording of the likely causes of a loss.
NO_REVENUE, FAR_ABOVE, ABOVE, UNCLEAR = (
    "No revenue generated", "Cost significantly exceeds revenue - pricing issue", "Pricing below cost",
    "Unknown - requires further analysis",
)


def rule_metrics(txn: DataFrame, offerings: DataFrame, start, end) -> DataFrame:
    """Everything the rules look at, one row per offering sold in the window.

    Facts are read once: sums per offering, customer and month over this window
    and the one before it feed every metric, so the joins and the scan behind
    ``txn`` are not repeated and a hot offering is spread over its customers.
    """
    start, end = as_date(start), as_date(end)
    prev_start, prev_end = previous_window(start, end)
    day, c = F.col("transaction_date"), F.col
    now, before = day.between(F.lit(start), F.lit(end)), day.between(F.lit(prev_start), F.lit(prev_end))
    amounts = {"r": "total_amount", "p": "profit", "c": "cost"}
    cells = k.within(txn, prev_start, end).groupBy("offering_id", "customer_id", period_start(day, "month").alias("month")).agg(
        *[F.sum(F.when(now, c(src))).alias(name) for name, src in amounts.items()], F.count(F.when(now, 1)).alias("n"),
        F.sum(F.when(before, c("total_amount"))).alias("br"), F.count(F.when(before, 1)).alias("bn"),
    )
    buyers = cells.groupBy("offering_id", "customer_id").agg(*[F.sum(x).alias(x) for x in ("r", "p", "c", "n", "br", "bn")])
    known = c("customer_id").isNotNull()
    sums = buyers.groupBy("offering_id").agg(
        *[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in ("r", "p", "c", "br")], F.sum("n").alias("n"), F.max("r").alias("top"),
        *[F.count_if(known & (c(x) > 0)).alias(f"{x}_all") for x in ("n", "bn")],
        *[F.count_if(known & (c(x) > 1)).alias(f"{x}_back") for x in ("n", "bn")],
    ).where(c("n") > 0)
    monthly = cells.groupBy("offering_id", "month").agg(F.sum("r").alias("r"), F.sum("n").alias("n")).where(c("n") > 0)
    steady = monthly.groupBy("offering_id").agg(
        F.count(F.lit(1)).alias("months"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    dims = offerings.select("id", "name", c("offering_type").alias("type"))
    rate_now, rate_before = F.coalesce(ratio(c("n_back"), c("n_all")), F.lit(0.0)), ratio(c("bn_back"), c("bn_all"))
    return (
        sums.join(steady, "offering_id").join(dims, c("offering_id") == c("id"))
        .select(
            "id", "name", "type", *[rounded(c(x), k.MONEY).alias(name) for x, name in (("r", "revenue"), ("p", "profit"), ("c", "cost"))],
            rounded(ratio_or(c("p"), c("r")) * 100, 2).alias("margin"), c("n").alias("transactions"), c("n_all").alias("customers"),
            rounded(ratio_or(c("top"), c("r")) * 100, 4).alias("top_customer_pct"),
            F.when(c("br") > 0, rounded(ratio(c("r") - c("br"), c("br")), 4)).alias("revenue_trend"),
            F.when(rate_before > 0, rounded(ratio(rate_before - rate_now, rate_before), 4)).alias("repeat_rate_decline"),
            k.stability_of(c("months"), c("mean"), c("sd")).alias("stability_score"),
        )
    )


def merge_metrics(offerings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Offerings with their metrics; offerings without sales keep NULL metrics."""
    extra = [c for c in metrics.columns if c not in offerings.columns or c == "id"]
    return offerings.join(metrics.select(*extra), "id", "left")


def _metric(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default))) if name in df.columns else F.lit(float(default))


def breakeven_increase(profit: Column, revenue: Column) -> Column:
    """Percent by which the price must rise so that revenue meets cost."""
    return F.when((profit < 0) & (revenue > 0), (ratio(revenue - profit, revenue) - 1) * 100).otherwise(0.0)


def _conditions(df: DataFrame) -> dict[str, Column]:
    profit, margin, sales = _metric(df, "profit", 0), _metric(df, "margin", 0), _metric(df, "transactions", 0)
    thin = _metric(df, "margin", 100)
    return {
        "LOSS_001": profit < 0,
        "LOSS_002": (thin > 0) & (thin < 5),
        "RISK_001": _metric(df, "top_customer_pct", 0) > 50,
        "RISK_002": _metric(df, "revenue_trend", 0) < -0.15,
        "RISK_003": _metric(df, "stability_score", 1) < 0.4,
        "GROWTH_001": (margin > 30) & (sales < 50),
        "GROWTH_002": (sales > 100) & (margin > 5) & (margin < 15),
        "CHURN_001": _metric(df, "repeat_rate_decline", 0) > 0.2,
    }


def _cells(df: DataFrame) -> dict[str, Column]:
    profit, revenue = _metric(df, "profit", 0), _metric(df, "revenue", 0)
    decline = _metric(df, "repeat_rate_decline", 0)
    return {
        "name": F.coalesce(F.col("name"), F.lit("Unknown")), "loss": F.abs(profit), "margin": _metric(df, "margin", 0),
        "transactions": _metric(df, "transactions", 0).cast("bigint"), "increase_pct": breakeven_increase(profit, revenue),
        "top_customer_pct": _metric(df, "top_customer_pct", 0), "decline_pct": F.abs(_metric(df, "revenue_trend", 0) * 100),
        "stability": _metric(df, "stability_score", 0) * 100, "potential_revenue": revenue, "margin_gain": revenue * 0.05,
        "decline": decline * 100, "at_risk_revenue": revenue * decline,
    }


def evaluate_rules(metrics: DataFrame) -> DataFrame:
    """One row per offering and rule that fires, most urgent first.

    All rules are tested in one projection; only those that hold are exploded.
    """
    conditions, cells = _conditions(metrics), _cells(metrics)
    fired = [
        F.when(conditions[rule], F.struct(
            F.lit(rule).alias("insight_type"), F.lit(severity).alias("severity"),
            F.concat(F.lit(f"{name}: "), cells["name"]).alias("title"), F.lit(text).alias("description"),
            fill_template(advice, cells).alias("recommendation"), fill_template(impact, cells).alias("expected_impact"),
        ))
        for rule, name, text, severity, advice, impact in RULES
    ]
    evidence = F.struct(*[F.col(c) for c in ("revenue", "profit", "margin", "transactions")])
    return (
        metrics.select(F.col("id").alias("offering_id"), F.col("name").alias("offering_name"), evidence.alias("evidence"),
                       F.explode(F.array_compact(F.array(*fired))).alias("i"))
        .select("offering_id", "offering_name", "i.*", F.lit(CONFIDENCE).alias("confidence"), "evidence",
                F.lit(False).alias("is_dismissed"))
        .orderBy(severity_rank(F.col("severity")), "insight_type", "offering_id")
    )


def _steps(value: Column, steps: list[tuple[Column, float]], otherwise: float) -> Column:
    out = None
    for condition, score in steps:
        out = F.when(condition, score) if out is None else out.when(condition, score)
    return out.otherwise(otherwise)


def risk_scores(metrics: DataFrame) -> DataFrame:
    """Mean of four risk factors per offering, 0 (low) to 1 (high)."""
    m, t, p = _metric(metrics, "margin", 0), _metric(metrics, "revenue_trend", 0), _metric(metrics, "top_customer_pct", 0)
    stable = _metric(metrics, "stability_score", 0.5)
    factors = [
        _steps(m, [(m < 0, 0.9), (m < 10, 0.6), (m < 20, 0.3)], 0.1), 1 - stable,
        _steps(p, [(p > 50, 0.8), (p > 30, 0.5)], 0.2),
        _steps(t, [(t < -0.2, 0.9), (t < -0.1, 0.6), (t < 0, 0.3)], 0.1),
    ]
    total = factors[0] + factors[1] + factors[2] + factors[3]
    return metrics.select("id", rounded(total / 4, 2).alias("risk_score"))


def breakeven(metrics: DataFrame) -> DataFrame:
    return metrics.select("id", rounded(breakeven_increase(F.col("profit"), F.col("revenue")), 4).alias("increase_pct"))


def loss_reason(revenue: Column, profit: Column) -> Column:
    cost = revenue - profit
    return F.when(revenue == 0, NO_REVENUE).when(cost > revenue * 2, FAR_ABOVE).when(cost > revenue, ABOVE).otherwise(UNCLEAR)


def loss_reasons(metrics: DataFrame) -> DataFrame:
    losing = metrics.where(F.col("profit") < 0)
    return losing.select("id", "name", rounded(F.abs("profit"), 4).alias("loss"),
                         loss_reason(F.col("revenue"), F.col("profit")).alias("reason"))


# Wording of explanations per insight type.
EXPLANATIONS = {
    "LOSS_001": """Based on the analysis, this offering is generating losses. 

Key findings:
- Current loss: ${loss:.2f}
- Revenue: ${revenue:.2f}
- Cost: ${cost:.2f}

The unit cost exceeds the selling price, meaning every sale results in a net loss. This could be due to:
1. **Pricing below cost** - The price may have been set without full cost visibility
2. **Hidden overhead** - Indirect costs may not be fully allocated
3. **Volume expectations** - Pricing assumed higher volumes that would reduce unit costs

Recommended action: {recommendation}

Expected impact: {expected_impact}""",
    "LOSS_002": """This offering has a dangerously thin profit margin of {margin:.1f}%.

While technically profitable, margins this low leave no room for:
- Unexpected costs
- Customer discounts
- Market fluctuations

Industry best practice suggests a minimum 15-20% margin for business sustainability.

Recommended action: {recommendation}""",
    "RISK_001": """Revenue concentration risk detected.

{top_customer_pct:.0f}% of this offering's revenue comes from a single customer. This creates significant business risk because:
1. Loss of this customer would severely impact revenue
2. The customer may leverage this dependency for discounts
3. Business planning becomes unpredictable

Recommended action: {recommendation}""",
    "GROWTH_001": """This is a high-potential growth opportunity.

The offering shows:
- Strong margin: {margin:.0f}%
- Low current volume: {transactions} transactions

The healthy margin suggests good product-market fit and pricing power. The low volume indicates untapped market potential.

Recommended action: {recommendation}""",
    "default": """Based on the data analysis, the following insight has been identified:

{description}

Evidence:
{evidence_summary}

Recommended action: {recommendation}

Expected impact: {expected_impact}""",
}
EXPECTED_IMPACT = "Improve business performance."


def explain(insights: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Explanation text of every insight from its evidence."""
    rows = insights
    share = F.lit(0.0)
    if metrics is not None and "top_customer_pct" in metrics.columns:
        rows = rows.join(metrics.select(F.col("id").alias("offering_id"), "top_customer_pct"), "offering_id", "left")
        share = F.coalesce("top_customer_pct", F.lit(0.0))
    revenue, profit, margin, sales = (F.coalesce(F.col(f"evidence.{c}").cast("double"), F.lit(0.0))
                                      for c in ("revenue", "profit", "margin", "transactions"))
    lines = F.concat_ws(
        "\n", F.when(revenue != 0, fill_template("- Revenue: ${v:,.2f}", {"v": revenue})),
        F.when(profit != 0, fill_template("- Profit: ${v:,.2f}", {"v": profit})),
        F.when(margin != 0, fill_template("- Margin: {v:.1f}%", {"v": margin})),
        F.when(sales != 0, fill_template("- Transactions: {v:,.0f}", {"v": sales})),
    )
    cells = {
        "loss": F.abs(profit), "revenue": revenue, "cost": revenue - profit, "margin": margin, "transactions": sales.cast("bigint"),
        "top_customer_pct": share, "description": F.col("title"), "recommendation": F.col("recommendation"),
        "expected_impact": F.lit(EXPECTED_IMPACT), "evidence_summary": F.when(lines != "", lines).otherwise("No metrics available."),
    }
    text = None
    for rule, template in EXPLANATIONS.items():
        if rule != "default":
            filled = fill_template(template, cells)
            text = F.when(F.col("insight_type") == rule, filled) if text is None else text.when(F.col("insight_type") == rule, filled)
    return rows.select("offering_id", "insight_type", text.otherwise(fill_template(EXPLANATIONS["default"], cells)).alias("explanation"))


def executive_summary(kpis: DataFrame, insights: DataFrame, period: str = "this period") -> DataFrame:
    """One text: totals, direction of revenue, urgent items and opportunities."""
    urgent = F.col("severity").isin("critical", "high")
    order = [severity_rank(F.col("severity")), "insight_type", "offering_id"]
    counts = insights.agg(F.count_if(urgent).alias("u"), F.count_if(F.col("severity") == "opportunity").alias("o")).select(
        F.struct("u", "o")).scalar()

    def first_titles(condition: Column, n: int) -> Column:
        top = insights.where(condition).orderBy(*order).limit(n).select("title", *[
            x.alias("_s") if isinstance(x, Column) else F.col(x) for x in order])
        listed = F.array_sort(F.collect_list(F.struct("_s", "insight_type", "offering_id", "title")))
        lines = F.array_join(F.transform(listed, lambda t: F.concat(F.lit("- "), t["title"], F.lit("\n"))), "")
        return top.agg(lines).scalar()

    c = F.col
    trend = c("revenue_trend")
    head = fill_template(
        "**Performance Summary for " + period + ":**\nTotal revenue was ${r:,.2f} with a profit of ${p:,.2f} ({m:.1f}% margin).\n",
        {"r": c("total_revenue"), "p": c("total_profit"), "m": c("profit_margin")})
    move = (
        F.when(trend > 0.1, fill_template("📈 Revenue grew {t:.0f}% compared to the previous period.\n", {"t": trend * 100}))
        .when(trend < -0.1, fill_template("📉 Revenue declined {t:.0f}% compared to the previous period.\n", {"t": F.abs(trend) * 100}))
        .when(trend.isNotNull(), "📊 Revenue remained relatively stable.\n").otherwise("")
    )
    alarms = F.when(counts["u"] > 0, F.concat(
        F.lit("\n**⚠️ "), counts["u"].cast("string"), F.lit(" critical/high-priority items require attention:**\n"), first_titles(urgent, 3)
    )).otherwise("")
    chances = F.when(counts["o"] > 0, F.concat(
        F.lit("\n**💡 "), counts["o"].cast("string"), F.lit(" growth opportunities identified:**\n"),
        first_titles(F.col("severity") == "opportunity", 2))).otherwise("")
    return kpis.select(F.concat(head, move, alarms, chances).alias("summary"))
