"""Star-schema metrics: KPIs, trends, top-k, losses, retention, daily rollup.

Inputs are canonical ``transactions`` (customer_id, offering_id,
transaction_date, quantity, total_amount, cost, profit), ``offerings`` and
``customers``.  Facts are aggregated by key before a dimension is joined, so a
hot offering or customer is reduced map-side and joins carry one row per key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.dates import as_date, period_label, period_start, previous_window
from ledgerlens.functions.numbers import ratio, ratio_or, rounded

MONEY = 4  # decimals kept in sums of amounts


def within(df: DataFrame, start: dt.date | str, end: dt.date | str, tenant: str | None = None) -> DataFrame:
    """Rows of one tenant whose transaction date lies in [start, end]."""
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    return df.where(F.col("transaction_date").between(F.lit(as_date(start)), F.lit(as_date(end))))


def _total(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0.0))


def _margin(profit: Column, revenue: Column) -> Column:
    return rounded(ratio_or(profit, revenue) * 100, 2)


def _change(current: Column, previous: Column) -> Column:
    """Relative change rounded to cents; NULL unless the earlier figure is positive."""
    return F.when(previous > 0, rounded(ratio(current - previous, previous), 2))


def period_metrics(txn: DataFrame, start, end) -> DataFrame:
    """Revenue, profit, cost, rows and distinct customers of one window."""
    by_customer = (
        within(txn, start, end)
        .groupBy("customer_id")
        .agg(F.sum("total_amount").alias("r"), F.sum("profit").alias("p"), F.sum("cost").alias("c"),
             F.count(F.lit(1)).alias("n"))
    )
    return by_customer.agg(
        rounded(_total("r"), MONEY).alias("revenue"),
        rounded(_total("p"), MONEY).alias("profit"),
        rounded(_total("c"), MONEY).alias("cost"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("txn_count"),
        F.count("customer_id").alias("customers"),
    )


def kpis(txn: DataFrame, start, end) -> DataFrame:
    """Headline figures of a window and their change against the window before.

    Both windows come from one scan: amounts are summed conditionally per
    customer first, which also gives exact distinct customers of either window
    without expanding rows.
    """
    start, end = as_date(start), as_date(end)
    prev_start, prev_end = previous_window(start, end)
    now = F.col("transaction_date").between(F.lit(start), F.lit(end))
    before = F.col("transaction_date").between(F.lit(prev_start), F.lit(prev_end))
    sums = []
    for tag, window in (("cur", now), ("prev", before)):
        for name, col in (("revenue", "total_amount"), ("profit", "profit"), ("cost", "cost")):
            sums.append(F.sum(F.when(window, F.col(col))).alias(f"{tag}_{name}"))
        sums.append(F.count(F.when(window, 1)).alias(f"{tag}_n"))
    by_customer = within(txn, prev_start, end).groupBy("customer_id").agg(*sums)
    totals = by_customer.agg(
        *[_total(f"{t}_{m}").alias(f"{t}_{m}") for t in ("cur", "prev") for m in ("revenue", "profit", "cost")],
        *[F.coalesce(F.sum(f"{t}_n"), F.lit(0)).alias(f"{t}_n") for t in ("cur", "prev")],
        *[F.count(F.when(F.col(f"{t}_n") > 0, F.col("customer_id"))).alias(f"{t}_customers") for t in ("cur", "prev")],
    )
    c = F.col
    margin_now, margin_before = ratio(c("cur_profit"), c("cur_revenue")), ratio(c("prev_profit"), c("prev_revenue"))
    return totals.select(
        rounded(c("cur_revenue"), MONEY).alias("total_revenue"),
        rounded(c("cur_profit"), MONEY).alias("total_profit"),
        rounded(c("cur_cost"), MONEY).alias("total_cost"),
        _margin(c("cur_profit"), c("cur_revenue")).alias("profit_margin"),
        c("cur_n").alias("transaction_count"),
        c("cur_customers").alias("unique_customers"),
        rounded(ratio_or(c("cur_revenue"), c("cur_n")), 2).alias("avg_order_value"),
        _change(c("cur_revenue"), c("prev_revenue")).alias("revenue_trend"),
        _change(c("cur_profit"), c("prev_profit")).alias("profit_trend"),
        F.when((c("cur_revenue") != 0) & (c("prev_revenue") != 0), _change(margin_now, margin_before)).alias("margin_trend"),
        _change(c("cur_customers"), c("prev_customers")).alias("customer_trend"),
    )


def trend(txn: DataFrame, start, end, granularity: str = "month") -> DataFrame:
    """Revenue, profit and cost per day, week or month, with axis labels."""
    return (
        within(txn, start, end)
        .groupBy(period_start(F.col("transaction_date"), granularity).alias("period"))
        .agg(*[rounded(_total(c), MONEY).alias(n) for n, c in
               (("revenue", "total_amount"), ("profit", "profit"), ("cost", "cost"))])
        .where(F.col("period").isNotNull())
        .select("period", period_label(F.col("period"), granularity).alias("label"), "revenue", "profit", "cost")
        .orderBy("period")
    )


def _by_offering(txn: DataFrame, *more: Column) -> DataFrame:
    return txn.groupBy("offering_id").agg(
        F.sum("total_amount").alias("revenue"), F.sum("profit").alias("profit"),
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("transactions"), *more,
    )


def _named(facts: DataFrame, offerings: DataFrame) -> DataFrame:
    dims = offerings.select(F.col("id"), F.col("name"), F.col("offering_type").alias("type"))
    return facts.join(dims, facts["offering_id"] == dims["id"], "inner").drop("offering_id")


def by_offering_type(txn: DataFrame, offerings: DataFrame, start, end) -> DataFrame:
    """Revenue, profit and rows per offering type; a missing type is ``Unknown``."""
    return (
        _named(_by_offering(within(txn, start, end)), offerings)
        .groupBy(F.coalesce("type", F.lit("Unknown")).alias("type"))
        .agg(rounded(_total("revenue"), MONEY).alias("revenue"), rounded(_total("profit"), MONEY).alias("profit"),
             F.sum("transactions").alias("transactions"))
    )


def offering_metrics(txn: DataFrame, offerings: DataFrame, start, end) -> DataFrame:
    """Revenue, profit, cost, margin, rows and distinct customers per offering."""
    facts = _by_offering(within(txn, start, end), F.count_distinct("customer_id").alias("customers"))
    c = F.col
    return _named(facts, offerings).select(
        "id", "name", "type",
        rounded(F.coalesce(c("revenue"), F.lit(0.0)), MONEY).alias("revenue"),
        rounded(F.coalesce(c("profit"), F.lit(0.0)), MONEY).alias("profit"),
        rounded(F.coalesce(c("cost"), F.lit(0.0)), MONEY).alias("cost"),
        _margin(c("profit"), c("revenue")).alias("margin"),
        "transactions", "customers",
    )


def offering_summary(txn: DataFrame, offerings: DataFrame, start, end) -> DataFrame:
    """How many offerings sold, gained and lost."""
    facts = _named(_by_offering(within(txn, start, end)), offerings)
    return facts.agg(
        F.count(F.lit(1)).alias("total_offerings"),
        F.count_if(F.col("profit") > 0).alias("profitable"),
        F.count_if(F.col("profit") < 0).alias("unprofitable"),
    )


def customer_metrics(txn: DataFrame, customers: DataFrame, start, end) -> DataFrame:
    """Revenue, rows, first and last date per customer and whether they came back."""
    facts = within(txn, start, end).groupBy("customer_id").agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("transactions"),
        F.min("transaction_date").alias("first_transaction"), F.max("transaction_date").alias("last_transaction"),
    )
    dims = customers.select("id", "name")
    return facts.join(dims, facts["customer_id"] == dims["id"], "inner").select(
        "id", "name", rounded(F.coalesce("revenue", F.lit(0.0)), MONEY).alias("revenue"), "transactions",
        "first_transaction", "last_transaction", (F.col("transactions") > 1).alias("is_repeat"),
    )


def retention(txn: DataFrame, start, end) -> DataFrame:
    """Repeat and one-time customers; rows without a customer are left out of both."""
    per_customer = within(txn, start, end).groupBy("customer_id").agg(
        F.sum("total_amount").alias("r"), F.count(F.lit(1)).alias("n")
    )
    known = F.col("customer_id").isNotNull()
    totals = per_customer.agg(
        F.count("customer_id").alias("total_customers"),
        F.count_if(known & (F.col("n") > 1)).alias("repeat_customers"),
        F.count_if(known & (F.col("n") == 1)).alias("one_time_customers"),
        _total("r").alias("r"),
    )
    return totals.select(
        "total_customers", "repeat_customers", "one_time_customers",
        rounded(ratio_or(F.col("r"), F.col("total_customers")), 2).alias("avg_revenue_per_customer"),
        rounded(ratio_or(F.col("repeat_customers"), F.col("total_customers")) * 100, 4).alias("retention_rate"),
    )


def loss_items(txn: DataFrame, offerings: DataFrame, start, end) -> DataFrame:
    """Offerings that lost money, worst first."""
    losing = _by_offering(within(txn, start, end)).where(F.col("profit") < 0)
    return (
        _named(losing, offerings)
        .select("id", "name", "type", rounded(F.col("profit"), MONEY).alias("loss"),
                rounded(F.coalesce("revenue", F.lit(0.0)), MONEY).alias("revenue"),
                rounded(F.coalesce("cost", F.lit(0.0)), MONEY).alias("cost"), "transactions")
        .orderBy("loss", "id")
    )


def loss_summary(txn: DataFrame, offerings: DataFrame, start, end) -> DataFrame:
    """Total loss and number of loss-making offerings."""
    losing = _named(_by_offering(within(txn, start, end)).where(F.col("profit") < 0), offerings)
    return losing.agg(
        rounded(F.abs(_total("profit")), MONEY).alias("total_losses"), F.count(F.lit(1)).alias("loss_making_items")
    )


def top_offerings(txn: DataFrame, offerings: DataFrame, start, end, limit: int | None = 10, sort_by: str = "revenue") -> DataFrame:
    """Best offerings by revenue or profit; all of them without a limit."""
    key = "revenue" if sort_by == "revenue" else "profit"
    ranked = (
        _named(_by_offering(within(txn, start, end)), offerings)
        .select("id", "name", "type", rounded(F.coalesce("revenue", F.lit(0.0)), MONEY).alias("revenue"),
                rounded(F.coalesce("profit", F.lit(0.0)), MONEY).alias("profit"))
        .orderBy(F.col(key).desc(), "id")
    )
    return ranked if limit is None else ranked.limit(limit)


def bottom_offerings(txn: DataFrame, offerings: DataFrame, start, end, limit: int | None = 10) -> DataFrame:
    """Worst loss-makers with the size of the loss; all of them without a limit."""
    losing = _by_offering(within(txn, start, end)).where(F.col("profit") < 0)
    ranked = (
        _named(losing, offerings)
        .select("id", "name", "type", rounded(F.coalesce("revenue", F.lit(0.0)), MONEY).alias("revenue"),
                rounded(F.col("profit"), MONEY).alias("profit"),
                rounded(F.abs("profit"), MONEY).alias("loss"))
        .orderBy("profit", "id")
    )
    return ranked if limit is None else ranked.limit(limit)


def daily_metrics(txn: DataFrame, keys: tuple[str, ...] = ("transaction_date", "offering_id")) -> DataFrame:
    """Daily rollup per offering (and per tenant when ``keys`` holds the tenant)."""
    return (
        txn.groupBy(*keys)
        .agg(F.sum("total_amount").alias("r"), F.sum("cost").alias("c"), F.sum("profit").alias("p"),
             F.count(F.lit(1)).alias("transaction_count"), F.count_distinct("customer_id").alias("unique_customers"))
        .select(*[F.col(k).alias("metric_date") if k == "transaction_date" else F.col(k) for k in keys],
                rounded(F.col("r"), MONEY).alias("revenue"), rounded(F.col("c"), MONEY).alias("cost"),
                rounded(F.col("p"), MONEY).alias("profit"), "transaction_count", "unique_customers",
                rounded(ratio_or(F.col("r"), F.col("transaction_count")), 2).alias("avg_order_value"))
    )


#: Size of a sketch of distinct customers as a power of two; the standard error of an estimate is about 0.4 %.
SKETCH_BITS = 16


def daily_sketches(txn: DataFrame, keys: tuple[str, ...] = ("transaction_date", "offering_id"), who: str = "customer_id") -> DataFrame:
    """Daily rollup that merges: sums, and a sketch of the distinct customers, to be stored and rolled up without the transactions."""
    return txn.groupBy(*keys).agg(
        F.sum("total_amount").alias("revenue"), F.sum("cost").alias("cost"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("transaction_count"),
        F.hll_sketch_agg(who, F.lit(SKETCH_BITS)).alias("customers")).withColumnRenamed("transaction_date", "metric_date")


def merged_metrics(stored: DataFrame, period: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stored days to weeks, months or years (and ``keys``): customers of several days count once, by the merged sketches.

    Counts of up to some thousand customers are exact in practice; larger ones are estimates.
    """
    start = F.trunc("metric_date", period).alias("period_start")
    return stored.groupBy(start, *keys).agg(
        F.sum("revenue").alias("r"), F.sum("cost").alias("c"), F.sum("profit").alias("p"), F.sum("transaction_count").alias("transaction_count"),
        F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers")).select(
        "period_start", *keys, rounded(F.col("r"), MONEY).alias("revenue"), rounded(F.col("c"), MONEY).alias("cost"),
        rounded(F.col("p"), MONEY).alias("profit"), "transaction_count", "unique_customers")


def top_customer_share(txn: DataFrame) -> DataFrame:
    """Percent of each offering's revenue that its largest customer brings."""
    return (
        txn.groupBy("offering_id", "customer_id").agg(F.sum("total_amount").alias("r"))
        .groupBy("offering_id").agg(F.max("r").alias("top"), F.sum("r").alias("all"))
        .select("offering_id", rounded(ratio_or(F.col("top"), F.col("all")) * 100, 4).alias("top_customer_pct"))
    )


def offering_trend(txn: DataFrame, start, end) -> DataFrame:
    """Change of revenue and of the repeat-customer rate per offering between two windows.

    ``repeat_rate_decline`` is the earlier share of returning customers minus the
    current one, relative to the earlier share.
    """
    start, end = as_date(start), as_date(end)
    prev_start, prev_end = previous_window(start, end)
    now = F.col("transaction_date").between(F.lit(start), F.lit(end))
    before = F.col("transaction_date").between(F.lit(prev_start), F.lit(prev_end))
    pairs = within(txn, prev_start, end).groupBy("offering_id", "customer_id").agg(
        F.sum(F.when(now, F.col("total_amount"))).alias("rc"), F.sum(F.when(before, F.col("total_amount"))).alias("rp"),
        F.count(F.when(now, 1)).alias("nc"), F.count(F.when(before, 1)).alias("np"),
    )
    known = F.col("customer_id").isNotNull()
    sums = pairs.groupBy("offering_id").agg(
        _total("rc").alias("rc"), _total("rp").alias("rp"),
        *[F.count_if(known & (F.col(f"n{t}") > 0)).alias(f"all_{t}") for t in "cp"],
        *[F.count_if(known & (F.col(f"n{t}") > 1)).alias(f"back_{t}") for t in "cp"],
    )
    rate_now = F.coalesce(ratio(F.col("back_c"), F.col("all_c")), F.lit(0.0))
    rate_before = ratio(F.col("back_p"), F.col("all_p"))
    return sums.select(
        "offering_id",
        F.when(F.col("rp") > 0, rounded(ratio(F.col("rc") - F.col("rp"), F.col("rp")), 4)).alias("revenue_trend"),
        F.when(rate_before > 0, rounded(ratio(rate_before - rate_now, rate_before), 4)).alias("repeat_rate_decline"),
    )


def stability(txn: DataFrame) -> DataFrame:
    """1 minus the coefficient of variation of an offering's monthly revenue, floored at 0."""
    monthly = txn.groupBy(
        "offering_id", period_start(F.col("transaction_date"), "month").alias("month")
    ).agg(F.sum("total_amount").alias("r"))
    stats = monthly.groupBy("offering_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")
    )
    return stats.select("offering_id", stability_of(F.col("n"), F.col("mean"), F.col("sd")).alias("stability_score"))


def stability_of(months: Column, mean: Column, spread: Column) -> Column:
    """0.5 for a single month, 0 without revenue, else 1 - spread / mean floored at 0."""
    return rounded(
        F.when(months < 2, F.lit(0.5)).when(mean == 0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), 1 - ratio(spread, mean))), 2)
