"""Chart data: grouped aggregates, KPIs, histograms, box plots, scatter samples."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.dates import period_start, to_timestamp_or_null
from ledgerlens.functions.numbers import (
    finite_or_zero, grouped_text, percent_text, ratio, ratio_or, rounded, short_money,
)
from ledgerlens.functions.text import heading_text, quoted
from ledgerlens.plans.catalog import columns_of, numeric_names
from ledgerlens.plans.grouped import grouped_quantiles
from ledgerlens.plans.ranks import Quantile, quantile_exprs

_GROUPED = {"sum": lambda y: F.coalesce(F.sum(y), F.lit(0.0)), "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max}


def group_agg(df: DataFrame, x: str, y: str | None = None, agg: str = "sum") -> DataFrame:
    """(label, value) per group of ``x``; rows without a key are dropped.

    An unknown aggregate sums; without ``y`` rows are counted.
    """
    keyed = df.where(quoted(x).isNotNull()).groupBy(quoted(x).alias("label"))
    if y is None or y not in df.columns:
        return keyed.agg(F.count(F.lit(1)).cast("double").alias("value"))
    if agg == "count":
        return keyed.agg(F.count(y).cast("double").alias("value"))
    return keyed.agg(rounded(_GROUPED.get(agg, _GROUPED["sum"])(quoted(y).cast("double")), 4).alias("value"))


def ranked_chart(df: DataFrame, x: str, y: str | None = None, agg: str = "sum", sort: str | None = "desc",
                 limit: int = 20) -> DataFrame:
    """The largest (or smallest) groups, as bar and pie charts show them."""
    value = F.col("value").asc_nulls_last() if sort == "asc" else F.col("value").desc_nulls_last()
    order = [value, F.col("label")] if sort in ("asc", "desc") else [F.col("label")]
    return group_agg(df, x, y, agg).orderBy(*order).limit(limit).select(F.col("label").cast("string").alias("label"), "value")


def time_chart(df: DataFrame, x: str, y: str | None = None, agg: str = "sum") -> DataFrame:
    """All groups in the order of the axis, as line and area charts need them."""
    return group_agg(df, x, y, agg).orderBy("label")


def custom_chart(df: DataFrame, x: str, y: str | None = None, agg: str = "sum", limit: int = 20) -> DataFrame:
    """First groups in key order, or the most frequent values when there is no ``y``."""
    if y is None:
        return ranked_chart(df, x, None, "count", "desc", limit)
    return ranked_chart(df, x, y, agg, None, limit)


def value_counts(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Most frequent values with their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        df.where(quoted(col).isNotNull()).groupBy(quoted(col).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "value").limit(n)
        .select("value", "count", rounded(ratio(F.col("count"), total) * 100, 2).alias("percentage"))
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Null count per column, one scan."""
    infos = columns_of(df)
    wide = df.agg(*[F.count_if(quoted(c.name).isNull()).alias(str(c.ordinal)) for c in infos])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c.name).alias("label"), F.col(str(c.ordinal)).alias("value")) for c in infos
    ])))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Columns per data type, counted over the columns that exist in the data."""
    infos = columns_of(df)
    wide = df.agg(F.count(F.lit(1)).alias("rows"))
    return (
        wide.select(F.explode(F.array(*[F.lit(c.dtype) for c in infos])).alias("label"))
        .groupBy("label").agg(F.count(F.lit(1)).alias("value"))
    )


def completeness(df: DataFrame) -> Column:
    """Percent of cells that are filled, as an aggregate expression."""
    filled = [F.count(quoted(c)) for c in df.columns]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return ratio(total, F.count(F.lit(1)) * len(df.columns)) * 100


def kpi_expr(df: DataFrame, agg: str, x: str | None = None, y: str | None = None) -> Column:
    """Aggregate expression of one KPI card; several cards share one ``agg``."""
    if agg == "count":
        return F.count(F.lit(1)).cast("double")
    if agg == "count_distinct":
        return F.count_distinct(quoted(x)).cast("double")
    if agg == "column_count":
        return F.max(F.lit(float(len(df.columns))))
    if agg == "completeness":
        return rounded(completeness(df), 4)
    if agg == "avg":
        return rounded(F.avg(quoted(y).cast("double")), 4)
    if agg == "avg_per_group":
        return rounded(ratio(F.sum(quoted(y).cast("double")), F.count_distinct(quoted(x))), 4)
    if agg == "calculated":
        left, right = y.split("-", 1)
        return rounded(F.sum(quoted(left).cast("double")) - F.sum(quoted(right).cast("double")), 4)
    if agg in ("accuracy", "error_rate"):
        right = F.coalesce(quoted(x) == quoted(y), F.lit(False))
        share = ratio(F.count_if(right if agg == "accuracy" else ~right), F.count(F.lit(1)))
        return rounded(share * 100, 4)
    if agg == "sum":
        return rounded(F.coalesce(F.sum(quoted(y).cast("double")), F.lit(0.0)), 4)
    raise ValueError(f"unknown KPI aggregate {agg}")


def kpi_text(value: Column, fmt: str = "number") -> Column:
    if fmt == "currency":
        return short_money(value)
    if fmt == "percent":
        return percent_text(value)
    return grouped_text(value)


def kpi_cards(df: DataFrame, cards: list[dict]) -> DataFrame:
    """(id, value, text) for a list of ``{id, agg, x, y, format}`` from one scan."""
    wide = df.agg(*[kpi_expr(df, c["agg"], c.get("x"), c.get("y")).alias(c["id"]) for c in cards])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c["id"]).alias("id"), F.coalesce(F.col(c["id"]), F.lit(0.0)).alias("value"),
                 kpi_text(F.coalesce(F.col(c["id"]), F.lit(0.0)), c.get("format", "number")).alias("text"))
        for c in cards
    ])))


def auto_kpis(df: DataFrame, semantic: dict[str, str], first: int = 6) -> DataFrame:
    """Total and average of every currency, numeric or count column, then the row count.

    ``semantic`` maps column names to semantic types; the first six are kept.
    """
    cards: list[tuple[str, str | None, str, Column]] = []
    numeric = set(numeric_names(df))
    for name in df.columns:
        if semantic.get(name) in ("currency", "numeric", "count") and name in numeric:
            fmt = "currency" if semantic[name] == "currency" else "number"
            value = quoted(name).cast("double")
            cards.append((f"Total {heading_text(name)}", name, fmt, finite_or_zero(F.sum(value))))
            cards.append((f"Avg {heading_text(name)}", name, fmt, finite_or_zero(F.avg(value))))
    cards.append(("Total Records", None, "number", F.count(F.lit(1)).cast("double")))
    cards = cards[:first]
    wide = df.agg(*[rounded(expr, 4).alias(f"k{i}") for i, (_, _, _, expr) in enumerate(cards)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(f"k{i}").alias("value"),
                 F.lit(fmt).alias("format"), F.lit(col).cast("string").alias("column"))
        for i, (label, col, fmt, _) in enumerate(cards)
    ])))


# Keywords that pick the revenue, cost and volume column.
REVENUE_WORDS = ("revenue", "sales", "amount", "total", "value", "price")
COST_WORDS = ("cost", "expense", "spend", "fee")
VOLUME_WORDS = ("quantity", "count", "units", "orders", "transactions")


def first_numeric_with(df: DataFrame, words: tuple[str, ...]) -> str | None:
    return next((c for c in numeric_names(df) if any(w in c.lower() for w in words)), None)


def financial_metrics(df: DataFrame) -> DataFrame:
    """Revenue, cost, margin and volume figures of the first matching columns."""
    revenue, cost, volume = (first_numeric_with(df, w) for w in (REVENUE_WORDS, COST_WORDS, VOLUME_WORDS))
    aggs: list[Column] = []
    if revenue:
        v = quoted(revenue).cast("double")
        aggs += [rounded(F.sum(v), 2).alias("revenue_total"), rounded(F.avg(v), 2).alias("revenue_average"),
                 rounded(F.min(v), 2).alias("revenue_min"), rounded(F.max(v), 2).alias("revenue_max"),
                 rounded(F.stddev_samp(v), 2).alias("revenue_std")]
        aggs += quantile_exprs(df, [Quantile("revenue_median", v, 0.5)])
    if cost:
        v = quoted(cost).cast("double")
        aggs += [rounded(F.sum(v), 2).alias("cost_total"), rounded(F.avg(v), 2).alias("cost_average")]
    if revenue and cost:
        r, c = F.sum(quoted(revenue).cast("double")), F.sum(quoted(cost).cast("double"))
        aggs += [rounded(r - c, 2).alias("gross_profit"), rounded(ratio_or(r - c, r) * 100, 2).alias("profit_margin"),
                 rounded(ratio_or(c, r) * 100, 2).alias("cost_ratio")]
    if volume:
        v = quoted(volume).cast("double")
        aggs += [F.sum(v).cast("bigint").alias("volume_total"), rounded(F.avg(v), 2).alias("volume_average")]
    out = df.agg(*aggs)
    return out.withColumn("revenue_median", rounded(F.col("revenue_median"), 2)) if revenue else out


def monthly_growth(df: DataFrame, date: str, value: str) -> DataFrame:
    """Change of the last month with data against the month before, in percent."""
    monthly = monthly_trend(df, date, value)
    # two rows are enough: the newest month and the one before it
    last_two = monthly.orderBy(F.col("month").desc()).limit(2)
    pair = last_two.agg(
        F.max_by("value", "month").alias("last"), F.min_by("value", "month").alias("prev"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") == 2)
    growth = F.when(F.col("prev") == 0, F.lit(0.0)).otherwise(
        ratio(F.col("last") - F.col("prev"), F.col("prev")) * 100
    )
    return pair.select(
        rounded(growth, 2).alias("monthly_growth_rate"),
        F.when(growth > 0, "increasing").when(growth < 0, "decreasing").otherwise("stable").alias("trend"),
    )


def monthly_trend(df: DataFrame, date: str, value: str) -> DataFrame:
    """Sum per calendar month, oldest first."""
    when = to_timestamp_or_null(quoted(date), df.schema[date].dataType)
    return (
        df.select(period_start(when.cast("date"), "month").alias("month"), quoted(value).cast("double").alias("v"))
        .where(F.col("month").isNotNull())
        .groupBy("month").agg(rounded(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("value"))
        .orderBy("month")
    )


def daily_series(df: DataFrame, date: str, value: str, last: int = 100) -> DataFrame:
    """Sum per day with missing days filled by 0; the last ``last`` days."""
    when = to_timestamp_or_null(quoted(date), df.schema[date].dataType).cast("date")
    daily = (
        df.select(when.alias("day"), quoted(value).cast("double").alias("v")).where(F.col("day").isNotNull())
        .groupBy("day").agg(F.sum("v").alias("v"))
    )
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    first = F.greatest(F.col("lo"), F.date_sub("hi", last - 1))
    days = span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence(first, F.col("hi"))).alias("day"))
    return days.join(daily, "day", "left").select(
        "day", rounded(F.coalesce("v", F.lit(0.0)), 4).alias("value")
    ).orderBy("day")


def histogram(df: DataFrame, col: str, bins: int | None = 20, low: float | None = None, high: float | None = None,
              extra: Column | None = None) -> DataFrame:
    """(bin, lower, upper, count) over equal bins, empty bins included.

    The last bin is closed.  ``bins=None`` chooses the number of bins from the
    narrower of the Sturges and Freedman-Diaconis widths.
    """
    source = df.select((quoted(col) if extra is None else extra).cast("double").alias("v")).where(F.col("v").isNotNull())
    if bins is None:
        frame = _auto_bins(source)
    elif low is not None and high is not None:
        frame = source.agg(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"), F.lit(bins).alias("bins"))
    else:
        frame = source.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(bins).alias("bins"))
    flat = F.col("lo") == F.col("hi")
    frame = frame.where(F.col("lo").isNotNull()).select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "bins",
    )
    s = frame.select(F.struct("lo", "hi", "bins").alias("s")).scalar()
    inside = source.where((F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"]))
    slot = F.least(F.floor((F.col("v") - s["lo"]) / (s["hi"] - s["lo"]) * s["bins"]), s["bins"].cast("bigint") - 1)
    counts = inside.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = frame.select("lo", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width"),
                         F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin", rounded(F.col("lo") + F.col("bin") * F.col("width"), 4).alias("lower"),
        rounded(F.col("lo") + (F.col("bin") + 1) * F.col("width"), 4).alias("upper"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    ).orderBy("bin")


def _auto_bins(source: DataFrame) -> DataFrame:
    stats = source.agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").cast("double").alias("n"),
        *quantile_exprs(source, [Quantile("q1", F.col("v"), 0.25), Quantile("q3", F.col("v"), 0.75)]),
    )
    span = F.col("hi") - F.col("lo")
    sturges = span / (F.log2("n") + 1)
    spread = 2 * (F.col("q3") - F.col("q1")) / F.cbrt("n")
    width = F.when(spread > 0, F.least(spread, sturges)).otherwise(sturges)
    bins = F.when(span > 0, F.ceil(F.round(F.try_divide(span, width), 9))).otherwise(1)
    return stats.select("lo", "hi", bins.cast("int").alias("bins"))


def boxplot(df: DataFrame, col: str) -> DataFrame:
    """Five-number summary with fences clipped to the data."""
    v = quoted(col).cast("double")
    row = df.agg(F.min(v).alias("min"), F.max(v).alias("max"), *quantile_exprs(
        df, [Quantile(n, v, p) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]))
    iqr = F.col("q3") - F.col("q1")
    return row.select(
        *[rounded(quoted(c), 4).alias(c) for c in ("min", "q1", "median", "q3", "max")],
        rounded(F.greatest(F.col("q1") - 1.5 * iqr, F.col("min")), 4).alias("lower_fence"),
        rounded(F.least(F.col("q3") + 1.5 * iqr, F.col("max")), 4).alias("upper_fence"),
    )


def boxplot_by_group(df: DataFrame, by: list[str], col: str, in_memory: int | None = None) -> DataFrame:
    """Five-number summary with clipped fences of every group, exact for groups of any size and number."""
    v = quoted(col).cast("double")
    five = (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))
    rows = grouped_quantiles(df.where(v.isNotNull()), by, [Quantile(n, v, p) for n, p in five], in_memory)
    iqr = F.col("q3") - F.col("q1")
    return rows.select(
        *[quoted(c) for c in by], *[rounded(quoted(n), 4).alias(n) for n, _ in five],
        rounded(F.greatest(F.col("q1") - 1.5 * iqr, F.col("min")), 4).alias("lower_fence"),
        rounded(F.least(F.col("q3") + 1.5 * iqr, F.col("max")), 4).alias("upper_fence"))


def boxplot_outliers(df: DataFrame, col: str, order_by: str, limit: int = 50) -> DataFrame:
    """First ``limit`` values beyond the fences, in row order."""
    v = quoted(col).cast("double")
    fences = df.agg(*quantile_exprs(df, [Quantile("q1", v, 0.25), Quantile("q3", v, 0.75)]))
    iqr = F.col("q3") - F.col("q1")
    s = fences.select(F.struct((F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))).scalar()
    return df.where((v < s["lo"]) | (v > s["hi"])).orderBy(quoted(order_by)).limit(limit).select(quoted(order_by), v.alias("value"))


def scatter(df: DataFrame, x: str, y: str, key: str, limit: int = 500) -> DataFrame:
    """A repeatable sample of point pairs: the rows whose key digests sort lowest."""
    return (
        df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
        .select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"), F.md5(quoted(key).cast("string")).alias("_k"))
        .orderBy("_k", "x", "y").limit(limit).drop("_k")
    )


def first_points(df: DataFrame, x: str, y: str, order_by: str, limit: int = 500) -> DataFrame:
    """First complete point pairs in row order."""
    return (
        df.where(quoted(x).isNotNull() & quoted(y).isNotNull()).orderBy(quoted(order_by)).limit(limit)
        .select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"))
    )


