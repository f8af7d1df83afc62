"""Column profiling and data quality.

The building block is a facts table: one row per column, made from one or two
shared scans whatever the number of columns.  Everything else here projects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.numbers import (
    adjusted_kurtosis, adjusted_skewness, finite_or_zero, k_squared, plain_text, ratio, rounded,
)
from ledgerlens.functions.text import contains_any, quoted
from ledgerlens.operators.charts import histogram
from ledgerlens.plans.catalog import (
    ALL_FACTS, ColumnInfo, columns_of, facts, frequencies, lane_text, leading_values, modes, numeric_names, pairwise_correlations, text_of, union_all, value_key,
    with_distinct, value_shapes,
)
from ledgerlens.plans.ordered import ROWS_PER_SLICE, with_neighbours
from ledgerlens.plans.ranks import Quantile, quantile_exprs

# Name fragments of each semantic type, in order of precedence.
PROFILE_TYPES = (
    ("identifier", ("id", "key", "code")),
    ("datetime", ("date", "time", "created", "updated", "timestamp")),
    ("currency", ("price", "cost", "amount", "revenue", "total", "salary", "income")),
    ("percentage", ("percent", "rate", "ratio", "pct")),
    ("integer", ("count", "quantity", "qty", "number", "num", "age")),
    ("text", ("name", "title", "description")),
    ("email", ("email",)),
    ("category", ("category", "type", "status", "gender", "class")),
)
LOADER_TYPES = (
    ("identifier", ("id", "key", "code")),
    ("datetime", ("date", "time", "created")),
    ("currency", ("price", "cost", "amount", "revenue", "total")),
    ("percentage", ("percent", "rate", "margin")),
    ("count", ("count", "quantity", "qty")),
    ("email", ("email",)),
    ("phone", ("phone",)),
    ("location", ("address", "city", "country")),
    ("category", ("category", "type", "status")),
)
# What can be done about an issue, first choice first.
FIX_OPTIONS = {
    ("Missing Values", "numeric"): ("drop", "fill_mean", "fill_median", "fill_zero", "interpolate", "ffill", "keep"),
    ("Missing Values", "other"): ("drop", "fill_mode", "fill_unknown", "keep"),
    ("Outliers", "any"): ("remove", "cap_iqr", "cap_percentile", "keep"),
    ("Skewed Distribution", "any"): ("log_transform", "sqrt_transform", "keep"),
    ("duplicates", "any"): ("drop_duplicates", "keep_first", "keep_last", "keep"),
}
# Wording of distribution shapes.
SYMMETRIC = "approximately symmetric"
RIGHT_SKEWED = "right-skewed (positively skewed) - tail extends right"
LEFT_SKEWED = "left-skewed (negatively skewed) - tail extends left"
HEAVY_TAILED = "heavy-tailed (leptokurtic) - more outliers than normal"
LIGHT_TAILED = "light-tailed (platykurtic) - fewer outliers than normal"
NORMAL_TAILED = "normal-like tails (mesokurtic)"
POSITIVE_SKEW = "positively skewed (right tail)"
NEGATIVE_SKEW = "negatively skewed (left tail)"


def by_name(name: Column, table: tuple) -> Column:
    """First type of ``table`` one of whose fragments occurs in the name, else NULL."""
    lowered = F.lower(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, fragments in table:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | lowered.contains(fragment)
        out = out.when(hit, kind)
    return out


def profile_type(name: Column, kind: Column, distinct: Column, rows: Column) -> Column:
    """Semantic type as the profiler sees it."""
    return F.coalesce(
        by_name(name, PROFILE_TYPES),
        F.when(kind.isin("numeric", "boolean"), "numeric").when(kind == "temporal", "datetime")
        .when((distinct < 20) & (rows > 100), "category").otherwise("text"),
    )


def loader_type(name: Column, kind: Column, date_share: Column) -> Column:
    """Semantic type as the loader sees it; ``date_share`` is the share of date-like values."""
    return F.coalesce(
        by_name(name, LOADER_TYPES),
        F.when(kind.isin("numeric", "boolean"), "numeric").when(kind == "temporal", "datetime")
        .when(date_share >= 0.7, "datetime").otherwise("text"),
    )


def samples(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """(ordinal, position, value): the first ``n`` non-null values of each column in row order.

    Each column is a bounded top-n over two pruned columns, never a full sort.
    """
    key = quoted(order_by)
    parts = []
    for c in columns_of(df):
        top = (
            df.where(quoted(c.name).isNotNull()).select(key.alias("_k"), text_of(c).alias("value"))
            .orderBy("_k", "value").limit(n)
            .agg(F.array_sort(F.collect_list(F.struct("_k", "value"))).alias("top"))
        )
        parts.append(top.select(F.lit(c.ordinal).alias("ordinal"), F.posexplode("top.value").alias("position", "value")))
    return union_all(parts)


def column_catalog(df: DataFrame) -> DataFrame:
    """One row per column as the loader records it."""
    want = ("mean", "variance", "min", "max", "sum", "median")
    table = with_distinct(facts(df, want=want), df).join(value_shapes(df).select("ordinal", "dated"), "ordinal", "left")
    c = F.col
    number = [rounded(finite_or_zero(c(k)), 4) for k in ("min", "max", "mean", "median", "std", "sum")]
    numeric = c("kind") == "numeric"
    return table.select(
        "ordinal", "name", "dtype", c("nulls").alias("null_count"), c("distinct").alias("unique_count"),
        loader_type(c("name"), c("kind"), c("dated")).alias("semantic_type"),
        *[F.when(numeric, v).alias(k) for k, v in zip(("min", "max", "mean", "median", "std", "sum"), number)],
    ).orderBy("ordinal")


def missing_severity(pct: Column) -> Column:
    return F.when(pct > 30, "critical").when(pct > 10, "warning").when(pct > 0, "info").otherwise("ok")


def missing(df: DataFrame) -> DataFrame:
    """Null count, percentage and severity per column."""
    pct = ratio(F.col("nulls"), F.col("rows")) * 100
    return facts(df, want=()).select(
        F.col("name").alias("column"), F.col("nulls").alias("missing"), rounded(pct, 2).alias("percentage"),
        missing_severity(pct).alias("severity"),
    )


def missing_patterns(df: DataFrame, order_by: str, columns: list[str] | None = None,
                     rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Longest run of nulls in row order and what it says, per column.

    The length of a run at a null row is its row number minus that of the last
    filled row, so one carried value replaces grouping the runs.
    """
    names = [c for c in (columns or df.columns) if c != order_by]
    rows = with_neighbours(df.select(*[quoted(c) for c in (order_by, *names)]), names, order_by, backward=False, rows_per_slice=rows_per_slice)
    runs = [
        F.max(F.when(quoted(c).isNull(), F.col("_rn") - F.coalesce(quoted(f"_prev_{c}")["_rn"], F.lit(0)))).alias(f"run_{i}")
        for i, c in enumerate(names)
    ]
    wide = rows.agg(F.count(F.lit(1)).alias("rows"), *runs,
                    *[F.count(quoted(c)).alias(f"filled_{i}") for i, c in enumerate(names)])
    table = wide.select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"filled_{i}").alias("filled"),
                 F.coalesce(F.col(f"run_{i}"), F.lit(0)).alias("longest_run")) for i, c in enumerate(names)
    ])))
    return table.select(
        "column", F.col("longest_run").cast("bigint").alias("longest_run"),
        F.when(F.col("filled") == F.col("rows"), "none").when(F.col("filled") == 0, "all_missing")
        .when(F.col("longest_run") > F.col("rows") * 0.1, "systematic_blocks").otherwise("random").alias("pattern"),
    )


def numeric_stats(df: DataFrame) -> DataFrame:
    """Location and spread of every numeric column, rounded to 4 decimals."""
    infos = columns_of(df, "numeric")
    want = ("mean", "variance", "min", "max", "sum", "q1", "median", "q3")
    table = facts(df, infos, want).join(F.broadcast(modes(df, infos)), "ordinal", "left")
    return table.select(
        F.col("name").alias("column"),
        *[rounded(F.col(k), 4).alias(k) for k in ("mean", "median")],
        rounded(F.col("mode").cast("double"), 4).alias("mode"),
        *[rounded(F.col(k), 4).alias(k) for k in ("std", "min", "max", "q1", "q3", "sum", "variance")],
    )


def shape_text(skew: Column, kurt: Column) -> Column:
    tail = F.when(kurt > 1, HEAVY_TAILED).when(kurt < -1, LIGHT_TAILED).otherwise(NORMAL_TAILED)
    side = F.when(F.abs(skew) < 0.5, SYMMETRIC).when(skew > 0, RIGHT_SKEWED).otherwise(LEFT_SKEWED)
    return F.concat(side, F.lit("; "), tail)


def shape(df: DataFrame) -> DataFrame:
    """Biased skewness and excess kurtosis with their wording."""
    skew, kurt = finite_or_zero(F.col("skew")), finite_or_zero(F.col("kurt"))
    return facts(df, columns_of(df, "numeric"), ("skew", "kurt")).select(
        F.col("name").alias("column"), rounded(skew, 4).alias("skewness"), rounded(kurt, 4).alias("kurtosis"),
        shape_text(skew, kurt).alias("interpretation"),
    )


def _adjusted() -> tuple[Column, Column]:
    n = F.col("rows") - F.col("nulls")
    return adjusted_skewness(n, F.col("skew")), adjusted_kurtosis(n, F.col("kurt"))


def shape_adjusted(df: DataFrame) -> DataFrame:
    """Sample-adjusted skewness and kurtosis with the skew wording."""
    skew, kurt = _adjusted()
    return facts(df, columns_of(df, "numeric"), ("skew", "kurt")).select(
        F.col("name").alias("column"), rounded(skew, 4).alias("skewness"), rounded(kurt, 4).alias("kurtosis"),
        F.when(F.abs(skew) < 0.5, SYMMETRIC).when(skew > 0, POSITIVE_SKEW).otherwise(NEGATIVE_SKEW).alias("skew_interpretation"),
    )


def normality(df: DataFrame) -> DataFrame:
    """K-squared normality test over all rows; NULL below eight values or for a constant column."""
    n = F.col("rows") - F.col("nulls")
    k2 = k_squared(n, F.col("skew"), F.col("kurt"))
    p = F.exp(-k2 / 2)
    return facts(df, columns_of(df, "numeric"), ("skew", "kurt")).select(
        F.col("name").alias("column"), rounded(k2, 4).alias("statistic"), rounded(p, 4).alias("p_value"),
        (p > 0.05).alias("is_normal"),
    )


def iqr_outliers(df: DataFrame) -> DataFrame:
    """Count, share, bounds and severity of values beyond 1.5 interquartile ranges."""
    filled = F.col("rows") - F.col("nulls")
    pct = ratio(F.col("outliers"), filled) * 100
    return facts(df, columns_of(df, "numeric"), (), outliers=True).select(
        F.col("name").alias("column"), F.col("outliers").alias("count"), rounded(pct, 2).alias("percentage"),
        rounded(F.col("lower"), 4).alias("lower_bound"), rounded(F.col("upper"), 4).alias("upper_bound"),
        F.when(pct > 5, "warning").when(F.col("outliers") > 0, "info").otherwise("ok").alias("severity"),
    )


def outlier_values(df: DataFrame, col: str) -> DataFrame:
    """All outlying values of a column, as rows."""
    v = quoted(col).cast("double")
    row = df.agg(*quantile_exprs(df, [Quantile("q1", v, 0.25), Quantile("q3", v, 0.75)]))
    iqr = F.col("q3") - F.col("q1")
    s = row.select(F.struct((F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))).scalar()
    return df.where((v < s["lo"]) | (v > s["hi"])).select(rounded(v, 4).alias("value"))


def skew_issues(df: DataFrame) -> DataFrame:
    """Columns with a skewness beyond 1."""
    skew = finite_or_zero(F.col("skew"))
    return (
        facts(df, columns_of(df, "numeric"), ("skew", "kurt")).where(F.abs(rounded(skew, 4)) > 1)
        .select(F.col("name").alias("column"), rounded(skew, 4).alias("skewness"),
                F.when(skew > 0, "Right (Positive)").otherwise("Left (Negative)").alias("direction"),
                F.when(F.abs(rounded(skew, 4)) > 3, "warning").otherwise("info").alias("severity"))
    )


def top_values(df: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent values of every non-numeric column and its cardinality flag."""
    infos = [c for c in columns_of(df) if c.kind in ("string", "temporal")]
    sizes = facts(df, infos, ()).select("ordinal", "name", "rows")
    return leading_values(df, infos, n).join(F.broadcast(sizes), "ordinal").select(
        F.col("name").alias("column"), "rank", "value", F.col("n").alias("count"),
        rounded(ratio(F.col("n"), F.col("rows")) * 100, 2).alias("percentage"),
        (F.col("distinct") > F.col("rows") * 0.5).alias("is_high_cardinality"),
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """Both semantic types of every column."""
    table = with_distinct(facts(df, want=()), df).join(value_shapes(df).select("ordinal", "dated"), "ordinal", "left")
    c = F.col
    return table.select(
        "ordinal", c("name").alias("column"),
        profile_type(c("name"), c("kind"), c("distinct"), c("rows")).alias("profile_type"),
        loader_type(c("name"), c("kind"), c("dated")).alias("loader_type"),
    )


def correlations(df: DataFrame, floor: float = 0.3) -> DataFrame:
    """Pairs of numeric columns correlated beyond ``floor``, strongest first."""
    r = F.col("r")
    size = F.abs(r)
    side = F.when(r > 0, "positive").otherwise("negative")
    band = (
        F.when(size > 0.8, F.concat(F.lit("very strong "), side)).when(size > 0.6, F.concat(F.lit("strong "), side))
        .when(size > 0.4, F.concat(F.lit("moderate "), side)).when(size > 0.2, F.concat(F.lit("weak "), side))
        .otherwise("negligible")
    )
    return (
        pairwise_correlations(df, numeric_names(df)).where(size > floor)
        .select(F.col("x").alias("column1"), F.col("y").alias("column2"), rounded(r, 4).alias("correlation"), band.alias("strength"))
        .orderBy(F.abs("correlation").desc(), "column1", "column2")
    )


#: Columns whose ranges one scan finds.
RANGES_PER_SCAN = 250


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, most: int | None = None, digits: int = 4) -> DataFrame:
    """Full matrix in long form (x, y, value), of all numeric columns or the first ``most``."""
    names = (columns or numeric_names(df))[:most]
    half = pairwise_correlations(df, names)
    if not names:
        return half.select("x", "y", F.col("r").alias("value"))
    blocks = [names[at:at + RANGES_PER_SCAN] for at in range(0, len(names), RANGES_PER_SCAN)]
    ones = union_all([df.agg(*[
        F.when(F.min(quoted(c)) < F.max(quoted(c)), F.lit(1.0)).alias(f"d{i}") for i, c in enumerate(block)
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.col(f"d{i}").alias("value")) for i, c in enumerate(block)
    ]))) for block in blocks])
    both = half.select(F.inline(F.array(
        F.struct(F.col("x"), F.col("y"), F.col("r").alias("value")),
        F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("r").alias("value")),
    )))
    return both.unionByName(ones).select("x", "y", rounded(F.col("value"), digits).alias("value"))


def strong_correlations(df: DataFrame, first: int = 10) -> DataFrame:
    """Up to ten pairs correlated beyond 0.5 among all numeric columns."""
    size = F.abs("r")
    return (
        pairwise_correlations(df, numeric_names(df)).where(size > 0.5)
        .select(F.col("x").alias("var1"), F.col("y").alias("var2"), rounded(F.col("r"), 4).alias("correlation"),
                F.when(size > 0.7, "strong").otherwise("moderate").alias("strength"))
        .orderBy(F.abs("correlation").desc(), "var1", "var2").limit(first)
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, and their share."""
    groups = df.select(*[_groupable(c) for c in columns_of(df)]).groupBy(*[f"`{c}`" for c in df.columns]).agg(
        F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kinds")).select(
        (F.col("rows") - F.col("kinds")).alias("count"),
        rounded(ratio(F.col("rows") - F.col("kinds"), F.col("rows")) * 100, 2).alias("percentage"),
    )


def _groupable(c: ColumnInfo) -> Column:
    """A column as a short grouping key: long text and nested values as digests."""
    col = value_key(c) if c.kind in ("string", "nested") else quoted(c.name)
    return col.alias(c.name)


def _table_level(df: DataFrame, want: tuple[str, ...] = (), outliers: bool = True, counts: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Facts with distinct counts, outliers and semantic types; and the duplicate row as a scalar struct."""
    table = with_distinct(facts(df, want=want, outliers=outliers), df, counts=counts)
    typed = table.withColumn(
        "semantic", profile_type(F.col("name"), F.col("kind"), F.col("distinct"), F.col("rows"))
    )
    return typed, duplicates(df).select(F.struct("count", "percentage")).scalar()


def quality_score(df: DataFrame) -> DataFrame:
    """0-100: completeness 40 %, identifier uniqueness, outliers and duplicates 20 % each."""
    typed, dup = _table_level(df)
    is_id = F.col("semantic") == "identifier"
    sums = typed.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("cols"), F.sum("nulls").alias("nulls"),
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers"),
        F.avg(F.when(is_id, ratio(F.col("distinct"), F.col("rows")) * 100)).alias("ids"),
    )
    cells = F.col("rows") * F.col("cols")
    complete = (1 - ratio(F.col("nulls"), cells)) * 100
    unique = F.coalesce("ids", F.lit(100.0))
    outlying = F.greatest(F.lit(0.0), 100 - ratio(F.col("outliers"), cells) * 100 * 10)
    repeated = F.greatest(F.lit(0.0), 100 - ratio(dup["count"], F.col("rows")) * 100 * 2)
    return sums.select(
        rounded(complete, 4).alias("completeness"), rounded(unique, 4).alias("uniqueness"),
        rounded(outlying, 4).alias("outlier_score"), rounded(repeated, 4).alias("duplicate_score"),
        rounded(complete * 0.4 + unique * 0.2 + outlying * 0.2 + repeated * 0.2, 1).alias("quality_score"),
    )


def issues(df: DataFrame) -> DataFrame:
    """Missing values, outliers and skew as rows (column, issue_type, severity, description, fixes)."""
    c = F.col
    filled = c("rows") - c("nulls")
    gap = ratio(c("nulls"), c("rows")) * 100
    out = ratio(c("outliers"), filled) * 100
    skew = rounded(finite_or_zero(c("skew")), 4)

    def fixes(issue: str, kind: str) -> Column:
        return F.array(*[F.lit(m) for m in FIX_OPTIONS[issue, kind]])

    def issue(kind: str, severity: Column, text: Column, options: Column) -> Column:
        return F.struct(F.lit(kind).alias("issue_type"), severity.alias("severity"), text.alias("description"),
                        options.alias("fixes"))

    gaps = F.when(c("nulls") > 0, issue(
        "Missing Values", missing_severity(gap),
        F.concat(plain_text(rounded(gap, 1), 1), F.lit("% missing values ("), c("nulls").cast("string"), F.lit(" rows)")),
        F.when(c("kind").isin("numeric", "boolean"), fixes("Missing Values", "numeric")).otherwise(fixes("Missing Values", "other")),
    ))
    outs = F.when(c("outliers") > 0, issue(
        "Outliers", F.when(out > 5, "warning").otherwise("info"),
        F.concat(c("outliers").cast("string"), F.lit(" outliers detected ("), plain_text(rounded(out, 1), 1), F.lit("%)")),
        fixes("Outliers", "any"),
    ))
    skews = F.when((c("kind") == "numeric") & (F.abs(skew) > 1), issue(
        "Skewed Distribution", F.when(F.abs(skew) > 3, "warning").otherwise("info"),
        F.concat(F.lit("Highly "), F.when(skew > 0, "Right (Positive)").otherwise("Left (Negative)"),
                 F.lit(" skewed (skew="), plain_text(skew, 4), F.lit(").")),
        fixes("Skewed Distribution", "any"),
    ))
    return (
        facts(df, want=("skew",), outliers=True)
        .select("ordinal", c("name").alias("column"), F.explode(F.array_compact(F.array(gaps, outs, skews))).alias("i"))
        .select("ordinal", "column", "i.*")
    )


def suggestions(df: DataFrame) -> DataFrame:
    """What to clean first: issues by priority, plus one line for duplicate rows."""
    found = issues(df).select(
        "ordinal",
        F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "warning", 2).otherwise(3).alias("priority"),
        "column", "issue_type", "description", F.element_at("fixes", 1).alias("recommended"),
        F.concat_ws(", ", "fixes").alias("options"),
    )
    repeated = duplicates(df).where(F.col("count") > 0).select(
        F.lit(len(df.columns)).alias("ordinal"), F.lit(2).alias("priority"), F.lit("all").alias("column"),
        F.lit("duplicates").alias("issue_type"),
        F.concat(F.col("count").cast("string"), F.lit(" duplicate rows found")).alias("description"),
        F.lit("drop_duplicates").alias("recommended"), F.lit(", ".join(FIX_OPTIONS["duplicates", "any"])).alias("options"),
    )
    return found.unionByName(repeated).orderBy("priority", "ordinal", "issue_type").drop("ordinal")


PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Everything about one numeric column in one row (histogram apart)."""
    return distributions(df, [col]).drop("column")


def distributions(df: DataFrame, names: list[str]) -> DataFrame:
    """Everything about numeric columns, a row for each; blocks of columns share their scans."""
    return union_all([_distributions(df, names[at:at + DISTRIBUTIONS_PER_SCAN]) for at in range(0, len(names), DISTRIBUTIONS_PER_SCAN)])


#: Columns whose distributions share two scans and a table of values.
DISTRIBUTIONS_PER_SCAN = 20


def _distributions(df: DataFrame, names: list[str]) -> DataFrame:
    cols = [quoted(n).cast("double") for n in names]
    wanted = [Quantile(f"p{p}_{i}", v, p / 100) for i, v in enumerate(cols) for p in PERCENTILES]
    measures = {
        "count": F.count, "missing": lambda v: F.count_if(v.isNull()), "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp,
        "min": F.min, "max": F.max, "g1": F.skewness, "g2": F.kurtosis,
    }
    wide = df.agg(*[fn(v).alias(f"{k}_{i}") for i, v in enumerate(cols) for k, fn in measures.items()], *quantile_exprs(df, wanted))
    keys = [*measures, *[f"p{p}" for p in PERCENTILES]]
    table = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(n).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in keys]) for i, n in enumerate(names)])))
    c = F.col
    iqr = c("p75") - c("p25")
    edges = wide.select(F.struct(*[e.alias(f"{side}_{i}") for i in range(len(names)) for side, e in (
        ("lo", c(f"p25_{i}") - 1.5 * (c(f"p75_{i}") - c(f"p25_{i}"))), ("hi", c(f"p75_{i}") + 1.5 * (c(f"p75_{i}") - c(f"p25_{i}"))))])).scalar()
    outside = df.agg(*[F.count_if((v < edges[f"lo_{i}"]) | (v > edges[f"hi_{i}"])).alias(f"n_{i}") for i, v in enumerate(cols)])
    beyond = outside.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), c(f"n_{i}").alias("beyond")) for i in range(len(names))])))
    infos = {info.name: info for info in columns_of(df)}
    usual = modes(df, [infos[n] for n in names]).select("ordinal", c("mode").cast("double").alias("mode"))
    places = F.create_map(*[x for n, i in zip(names, range(len(names))) for x in (F.lit(infos[n].ordinal), F.lit(i))])
    rows = table.join(F.broadcast(beyond), "i").join(F.broadcast(usual.select(places[c("ordinal")].alias("i"), "mode")), "i", "left")
    skew, kurt = adjusted_skewness(c("count"), c("g1")), adjusted_kurtosis(c("count"), c("g2"))
    k2 = k_squared(c("count"), c("g1"), c("g2"))
    return rows.select(
        "column", "count", "missing", rounded(ratio(c("missing"), c("missing") + c("count")) * 100, 2).alias("missing_pct"),
        *[rounded(c(k), 4).alias(k) for k in ("mean", "std", "variance", "min", "max")],
        rounded(c("mode"), 4).alias("mode"), rounded(c("max") - c("min"), 4).alias("range"),
        *[rounded(c(f"p{p}"), 4).alias(f"p{p}") for p in PERCENTILES], rounded(iqr, 4).alias("iqr"),
        rounded(skew, 4).alias("skewness"), rounded(kurt, 4).alias("kurtosis"),
        c("beyond").alias("outliers"), rounded(ratio(c("beyond"), c("count")) * 100, 2).alias("outlier_pct"),
        rounded(c("p25") - 1.5 * iqr, 4).alias("lower_bound"), rounded(c("p75") + 1.5 * iqr, 4).alias("upper_bound"),
        rounded(F.exp(-k2 / 2), 4).alias("normal_p_value"),
    )


def distribution_histogram(df: DataFrame, col: str) -> DataFrame:
    return histogram(df, col, None)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns per kind, share of missing cells and duplicate rows."""
    infos = columns_of(df)
    dup = duplicates(df).select("count").scalar()
    sums = facts(df, want=()).agg(F.max("rows").alias("rows"), F.sum("nulls").alias("nulls"),
                         *[F.count_if(F.col("kind") == k).alias(k) for k in ("numeric", "string", "temporal")])
    cells = F.col("rows") * len(infos)
    return sums.select(
        "rows", F.lit(len(infos)).cast("bigint").alias("columns"), F.col("numeric").alias("numeric_columns"),
        F.col("string").alias("categorical_columns"), F.col("temporal").alias("datetime_columns"),
        rounded(ratio(F.col("nulls"), cells) * 100, 2).alias("missing_pct"), dup.alias("duplicate_rows"),
    )


def feature_table(df: DataFrame, most: int | None = None) -> DataFrame:
    """Type, gaps, distinct values, mean and spread of the numeric columns, all or the first ``most``."""
    infos = columns_of(df, "numeric")[:most]
    return with_distinct(facts(df, infos, ("mean", "variance")), df, infos).select(
        F.col("name").alias("feature"), "dtype", rounded(ratio(F.col("nulls"), F.col("rows")) * 100, 2).alias("missing_pct"),
        F.col("distinct").alias("unique"), rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("std"), 4).alias("std"),
    )


# Name fragments that mark a prediction target.
TARGET_WORDS = ("target", "label", "class", "y")


def ml_readiness(df: DataFrame) -> DataFrame:
    """100 less penalties for missing cells, id-like strings and duplicate rows."""
    typed, dup = _table_level(df, outliers=False)
    high = (F.col("kind") == "string") & (F.col("distinct") > F.col("rows") * 0.5)
    sums = typed.agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("cols"), F.sum("nulls").alias("nulls"),
                     F.count_if(high).alias("wide"), F.max(contains_any(F.lower("name"), F.array(*[F.lit(w) for w in TARGET_WORDS]))).alias("has_target"))
    gaps = ratio(F.col("nulls"), F.col("rows") * F.col("cols")) * 100
    dups = ratio(dup["count"], F.col("rows")) * 100
    score = 100 - F.least(F.lit(20.0), gaps) - 5 * F.col("wide") - F.when(dups > 5, 10).otherwise(0)
    return sums.select(
        rounded(F.greatest(F.lit(0.0), score), 1).alias("score"), rounded(gaps, 2).alias("missing_pct"),
        F.col("wide").alias("high_cardinality_columns"), rounded(dups, 2).alias("duplicate_pct"), "has_target",
    )


def data_insights(df: DataFrame, first: int = 5) -> DataFrame:
    """Warnings for columns with more than a fifth of their values missing."""
    pct = ratio(F.col("nulls"), F.col("rows")) * 100
    return (
        facts(df, want=()).where(pct > 20).orderBy("ordinal").limit(first)
        .select(F.lit("warning").alias("type"), F.concat(F.lit("High Missing Values in "), F.col("name")).alias("title"),
                F.concat(plain_text(rounded(pct, 1), 1), F.lit("% missing")).alias("description"), F.col("name").alias("column"))
    )


def describe(df: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    return facts(df, columns_of(df, "numeric"), ("mean", "variance", "min", "max", "q1", "median", "q3")).select(
        F.col("name").alias("column"), (F.col("rows") - F.col("nulls")).alias("count"),
        *[rounded(F.col(k), 4).alias(k) for k in ("mean", "std", "min", "q1", "median", "q3", "max")],
    )


def distinct_per_column(df: DataFrame) -> DataFrame:
    """(column, unique, percentage) for every column, nulls ignored."""
    infos = columns_of(df)
    return with_distinct(facts(df, infos, ()), df, infos).select(
        F.col("name").alias("column"), F.col("distinct").alias("unique"),
        rounded(ratio(F.col("distinct"), F.col("rows")) * 100, 2).alias("percentage"),
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column with everything the profiler reports about it."""
    infos = columns_of(df)
    leading = leading_values(df, infos)  # one table of values for distinct counts and modes
    typed, _ = _table_level(df, ALL_FACTS, counts=leading.select("ordinal", "distinct"))
    table = typed.join(F.broadcast(leading.select("ordinal", F.col("value").alias("mode"))), "ordinal", "left")
    c = F.col
    numeric = c("kind") == "numeric"
    skew, kurt = finite_or_zero(c("skew")), finite_or_zero(c("kurt"))
    k2 = k_squared(c("rows") - c("nulls"), c("skew"), c("kurt"))
    gap = ratio(c("nulls"), c("rows")) * 100
    return table.select(
        "ordinal", c("name").alias("column"), "dtype", "semantic", c("nulls").alias("missing"),
        rounded(gap, 2).alias("missing_pct"), missing_severity(gap).alias("missing_severity"),
        c("distinct").alias("unique"), rounded(ratio(c("distinct"), c("rows")) * 100, 2).alias("unique_pct"),
        *[rounded(c(k), 4).alias(k) for k in ("mean", "median", "std", "min", "max", "q1", "q3", "sum", "variance")],
        F.when(numeric, rounded(skew, 4)).alias("skewness"), F.when(numeric, rounded(kurt, 4)).alias("kurtosis"),
        F.when(numeric, shape_text(skew, kurt)).alias("interpretation"), rounded(F.exp(-k2 / 2), 4).alias("normal_p_value"),
        "outliers", rounded(c("lower"), 4).alias("lower_bound"), rounded(c("upper"), 4).alias("upper_bound"),
        F.when(~numeric, c("distinct") > c("rows") * 0.5).alias("is_high_cardinality"), "mode",
    ).orderBy("ordinal")

