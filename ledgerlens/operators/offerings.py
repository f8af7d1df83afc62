"""What kind of thing an offering is, from how it sells and what it is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.numbers import ratio, rounded

# Per type its keywords, the sales patterns it shows and its weight.
# A pattern without a signal in the data still counts as one of the type's patterns.
OFFERING_TYPES = (
    ("physical_product", ("product", "item", "goods", "hardware", "equipment", "material"),
     ("integer_quantity", "has_sku", "has_inventory"), 1.0),
    ("service", ("service", "consulting", "hours", "session", "support", "labor"), ("decimal_quantity", "time_based"), 0.95),
    ("subscription", ("subscription", "plan", "monthly", "annual", "recurring", "membership"),
     ("recurring_pattern", "same_customer_multiple"), 0.9),
    ("event", ("event", "ticket", "registration", "conference", "workshop", "training"), ("date_specific", "limited_quantity"), 0.85),
    ("bundle", ("bundle", "package", "combo", "kit", "set"), ("multiple_components",), 0.8),
    ("digital_asset", ("download", "digital", "software", "license", "access", "ebook"), ("no_shipping", "instant_delivery"), 0.85),
    ("license", ("license", "seats", "users", "perpetual", "subscription"), ("has_expiration", "user_based"), 0.8),
    ("rental", ("rental", "lease", "rent", "hire", "temporary"), ("has_return_date", "duration_based"), 0.75),
    ("usage_based", ("usage", "consumption", "metered", "per-use", "credits"), ("variable_quantity", "unit_pricing"), 0.75),
)
DEFAULT_TYPE, DEFAULT_CONFIDENCE, ACCEPTED_ABOVE = "physical_product", 0.5, 0.3


def interval_regularity(txn: DataFrame) -> DataFrame:
    """Mean and spread of the days between consecutive sales of an offering.

    Sales are first counted per day.  Sales on the same day are zero days apart,
    so the gaps between distinct days and two counts give the exact moments, and
    a window sees at most one row per calendar day however hot an offering is.
    """
    per_day = txn.where(F.col("transaction_date").isNotNull()).groupBy("offering_id", "transaction_date").agg(
        F.count(F.lit(1)).alias("n"))
    gap = F.datediff("transaction_date", F.lag("transaction_date").over(
        Window.partitionBy("offering_id").orderBy("transaction_date"))).cast("double")
    sums = per_day.withColumn("gap", gap).groupBy("offering_id").agg(
        (F.sum("n") - 1).cast("double").alias("m"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("q"),
    ).where(F.col("m") >= 1)
    variance = F.try_divide(F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("m")), F.col("m") - 1)
    spread = F.sqrt(F.greatest(F.lit(0.0), variance))
    return sums.select(
        "offering_id", rounded(ratio(F.col("s"), F.col("m")), 4).alias("mean_gap"),
        F.when(F.col("m") > 1, rounded(spread, 4)).alias("std_gap"),
        F.floor(F.round(ratio(F.col("s"), F.col("m")), 6)).cast("bigint").alias("avg_days_between"),
        F.coalesce(F.when(F.col("m") > 1, F.floor(F.round(spread, 6)) < 5), F.lit(False)).alias("regular_interval"),
    )


def offering_signals(txn: DataFrame) -> DataFrame:
    """Quantity, customer, date and amount signals per offering."""
    q, a = F.col("quantity"), F.col("total_amount")
    base = txn.groupBy("offering_id").agg(
        F.avg((q == F.floor(q)).cast("double")).alias("int_ratio"), F.avg(q).alias("avg_quantity"), F.var_samp(q).alias("quantity_variance"),
        F.count("customer_id").alias("known"), F.count_distinct("customer_id").alias("buyers"),
        F.avg(a).alias("avg_amount"), F.var_samp(a).alias("amount_variance"), F.count_distinct(a).alias("prices"),
        F.count(a).alias("priced"),
    )
    repeat = F.when(F.col("buyers") > 0, 1 - ratio(F.col("buyers"), F.col("known")))
    return base.join(interval_regularity(txn), "offering_id", "left").select(
        "offering_id", F.when(F.col("int_ratio") > 0.9, "integer").when(F.col("int_ratio").isNotNull(), "decimal").alias("quantity_type"),
        rounded(F.col("avg_quantity"), 4).alias("avg_quantity"), rounded(F.col("quantity_variance"), 4).alias("quantity_variance"),
        rounded(repeat, 4).alias("repeat_ratio"), (repeat > 0.1).alias("has_repeat_customers"), "avg_days_between",
        F.coalesce("regular_interval", F.lit(False)).alias("regular_interval"),
        rounded(F.col("avg_amount"), 4).alias("avg_amount"), rounded(F.col("amount_variance"), 2).alias("amount_variance"),
        F.when(F.col("priced") > 0, F.col("prices") < 5).alias("consistent_pricing"),
    )


def _shown(pattern: str) -> Column | None:
    """The signal behind a pattern, or None when the data cannot show it."""
    return {
        "integer_quantity": F.col("quantity_type") == "integer",
        "decimal_quantity": F.col("quantity_type") == "decimal",
        "time_based": F.col("quantity_type") == "decimal",
        "recurring_pattern": F.col("regular_interval"),
        "same_customer_multiple": F.col("repeat_ratio") > 0.3,
    }.get(pattern)


def _count(hits: list[Column]) -> Column:
    total = F.lit(0)
    for hit in hits:
        total = total + F.when(hit, 1).otherwise(0)
    return total


def type_score(keywords: tuple, patterns: tuple, weight: float) -> Column:
    name = F.lower(F.coalesce(F.col("name"), F.lit("")))
    named = _count([name.contains(k) for k in keywords]) / F.lit(float(len(keywords)))
    shown = _count([s for s in map(_shown, patterns) if s is not None]) / F.lit(float(len(patterns)))
    return (named * 0.5 + shown * 0.5) * weight


def offering_types(signals: DataFrame, offerings: DataFrame) -> DataFrame:
    """Best type per offering; ties go to the type declared first, weak evidence to the default."""
    named = signals.join(offerings.select(F.col("id").alias("offering_id"), "name"), "offering_id", "left")
    scored = [
        F.struct(F.round(type_score(k, p, w), 9).alias("score"), F.lit(-i).alias("first"), F.lit(t).alias("type"))
        for i, (t, k, p, w) in enumerate(OFFERING_TYPES)
    ]
    best = F.array_max(F.array(*scored))
    sure = F.col("best.score") > ACCEPTED_ABOVE
    return named.withColumn("best", best).select(
        "offering_id", "name", F.when(sure, F.col("best.type")).otherwise(DEFAULT_TYPE).alias("type"),
        F.when(sure, rounded(F.least(F.col("best.score"), F.lit(0.99)), 2)).otherwise(DEFAULT_CONFIDENCE).alias("confidence"),
        rounded(F.col("best.score"), 3).alias("best_score"),
    )


def offering_names(txn: DataFrame, offerings: DataFrame) -> DataFrame:
    """Name per sold offering: from the dimension, else the name of its earliest sale."""
    seen = [F.min_by("offering_name", "transaction_date").alias("seen")] if "offering_name" in txn.columns else []
    sold = txn.groupBy("offering_id").agg(F.count(F.lit(1)).alias("transactions"), *seen)
    named = sold.join(offerings.select(F.col("id").alias("offering_id"), "name"), "offering_id", "left")
    fallback = F.col("seen") if seen else F.lit(None).cast("string")
    return named.select("offering_id", F.coalesce("name", fallback).alias("name"), "transactions")
