"""Fixed answers to business questions, each a combination of the KPI operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.dates import previous_window
from ledgerlens.functions.numbers import ratio_or, rounded
from ledgerlens.functions.text import fill_template
from ledgerlens.operators import kpis as k
from ledgerlens.operators.filters import high_margin
from ledgerlens.operators.insights import loss_reason

# A loss listed from here, and one that suggests discontinuing.
LISTED_LOSS, HEAVY_LOSS = 500, 1000
# Rows shown by an answer; totals and counts cover all rows.
SHOWN = 5


def _headline(txn: DataFrame, start, end) -> Column:
    return k.kpis(txn, start, end).select(F.struct("*")).scalar()


def revenue(txn, offerings, start, end) -> DataFrame:
    """The five best offerings beside total revenue and its trend."""
    h = _headline(txn, start, end)
    return k.top_offerings(txn, offerings, start, end, 5, "revenue").select(
        "id", "name", "revenue", "profit", h["total_revenue"].alias("total_revenue"), h["revenue_trend"].alias("trend"),
        fill_template("Your total revenue for the period is ${v:,.2f}.", {"v": h["total_revenue"]}).alias("summary"))


def profit(txn, offerings, start, end) -> DataFrame:
    """The five most profitable offerings beside profit, margin and trend."""
    h = _headline(txn, start, end)
    return k.top_offerings(txn, offerings, start, end, 5, "profit").select(
        "id", "name", "revenue", "profit", h["total_profit"].alias("total_profit"), h["profit_margin"].alias("profit_margin"),
        h["profit_trend"].alias("trend"),
        fill_template("Your total profit is ${p:,.2f} with a {m:.1f}% margin.", {"p": h["total_profit"], "m": h["profit_margin"]}).alias("summary"))


def loss(txn, offerings, start, end) -> DataFrame:
    """The five worst losses with their likely cause, beside the total of all losses."""
    total = k.loss_summary(txn, offerings, start, end).select(F.struct("*")).scalar()
    return k.bottom_offerings(txn, offerings, start, end, SHOWN).select(
        "id", F.col("name").alias("offering"), "loss", loss_reason(F.col("revenue"), F.col("profit")).alias("reason"),
        total["total_losses"].alias("total_loss"),
        fill_template("You are losing ${v:,.2f} across {n} offerings.", {"v": total["total_losses"], "n": total["loss_making_items"]}).alias("summary"))


def growth(txn, offerings, start, end) -> DataFrame:
    """The five most profitable of all high-margin offerings."""
    margins = high_margin(k.top_offerings(txn, offerings, start, end, None, "profit"))
    return margins.orderBy(F.col("profit").desc(), "id").limit(SHOWN).withColumn(
        "summary", F.lit("Focus on your highest-margin offerings with growth potential."))


def risk(txn, offerings, start, end) -> DataFrame:
    """The five worst loss-makers as risks, beside the number of all of them."""
    n = k.loss_summary(txn, offerings, start, end).select("loss_making_items").scalar()
    return k.bottom_offerings(txn, offerings, start, end, SHOWN).select(
        "id", F.col("name").alias("offering"), F.lit("Negative profit margin").alias("risk_factors"),
        F.lit("Review pricing or discontinue").alias("recommendation"),
        F.concat(n.cast("string"), F.lit(" offerings show risk indicators.")).alias("summary"))


def customer(txn, offerings, start, end) -> DataFrame:
    """Number of customers and what they spend on average."""
    h = k.kpis(txn, start, end)
    each = ratio_or(F.col("total_revenue"), F.col("unique_customers"))
    return h.select(
        F.col("unique_customers").alias("total_customers"), rounded(each, 2).alias("avg_revenue_per_customer"),
        F.col("transaction_count").alias("total_transactions"),
        fill_template("You have {n} customers with average revenue of ${v:,.2f} per customer.",
                      {"n": F.col("unique_customers"), "v": each}).alias("summary"))


def discontinue(txn, offerings, start, end) -> DataFrame:
    """The five worst of all offerings that lose too much to keep as they are, beside their number."""
    big = k.bottom_offerings(txn, offerings, start, end, None).where(F.col("loss") > LISTED_LOSS)
    n = big.agg(F.count(F.lit(1))).scalar()
    return big.orderBy("profit", "id").limit(SHOWN).select(
        "id", F.col("name").alias("offering"), "loss",
        F.when(F.col("loss") > HEAVY_LOSS, "Consider discontinuing").otherwise("Review pricing").alias("recommendation"),
        F.concat(n.cast("string"), F.lit(" offerings are candidates for discontinuation or major revision.")).alias("summary"))


def compare(txn, offerings, start, end) -> DataFrame:
    """This period and the one before it, one row each."""
    prev_start, prev_end = previous_window(start, end)

    def period(name: str, a, b) -> DataFrame:
        return k.kpis(txn, a, b).select(
            F.lit(name).alias("period"), F.lit(str(a)).alias("start"), F.lit(str(b)).alias("end"), F.col("total_revenue").alias("revenue"),
            F.col("total_profit").alias("profit"), F.col("profit_margin").alias("margin"),
            F.col("revenue_trend").alias("revenue_change"), F.col("profit_trend").alias("profit_change"))

    return period("current", start, end).unionByName(period("previous", prev_start, prev_end))


def general(txn, offerings, start, end) -> DataFrame:
    """Overview figures."""
    return k.kpis(txn, start, end).select(
        F.col("total_revenue").alias("revenue"), F.col("total_profit").alias("profit"), F.col("profit_margin").alias("margin"),
        F.col("unique_customers").alias("customers"), F.col("transaction_count").alias("transactions"),
        F.lit("Here's an overview of your business performance:").alias("summary"))


ANSWERS = {
    "revenue": revenue, "loss": loss, "profit": profit, "growth": growth, "risk": risk, "customer": customer,
    "discontinue": discontinue, "compare": compare,
}


def answer(question_type: str, txn: DataFrame, offerings: DataFrame, start, end) -> DataFrame:
    """The answer to a question of a given type; unknown types get the overview."""
    return ANSWERS.get(question_type, general)(txn, offerings, start, end)
