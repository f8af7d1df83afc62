"""Row filters, column selection and pagination."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.dates import to_timestamp_or_null
from ledgerlens.functions.numbers import ratio
from ledgerlens.functions.text import heading_text, quoted
from ledgerlens.plans.catalog import columns_of, distinct_counts, frequencies, lane_text, numeric_names

# Names that mark a column as the target or as no feature.
TARGET_NAMES = ("target", "label", "y", "actual", "class", "id", "index")
# Fixed value: rank of each insight severity, most urgent first.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "opportunity": 4}


def slicer_filter(df: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """Keep rows whose text form equals a value, or one of a list; unknown columns are ignored."""
    for col, value in wanted.items():
        if col in df.columns:
            values = value if isinstance(value, (list, tuple)) else [value]
            df = df.where(quoted(col).cast("string").isin([str(v) for v in values]))
    return df


def chart_filter(df: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """Like ``slicer_filter`` but compares typed values, so filters reach the scan."""
    for col, value in wanted.items():
        if col in df.columns:
            df = df.where(quoted(col).isin(list(value)) if isinstance(value, (list, tuple)) else quoted(col) == value)
    return df


def slicer_options(df: DataFrame, columns: list[str] | None = None, below: int = 50) -> DataFrame:
    """(column, option) for every column with 2 to 49 distinct values.

    Only columns under the limit leave the aggregation, so no list of values
    grows with the data.
    """
    infos = [c for c in columns_of(df) if (columns is None or c.name in columns) and c.kind != "nested"]
    counted = frequencies(df, infos, readable=True)
    few = (
        counted.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct"))
        .where((F.col("distinct") > 1) & (F.col("distinct") < below))
    )
    names = F.element_at(F.array(*[F.lit(c.name) for c in infos]), F.col("pos"))
    position = {c.ordinal: i + 1 for i, c in enumerate(infos)}
    pos = F.element_at(F.create_map(*[F.lit(v) for kv in position.items() for v in kv]), F.col("ordinal"))
    return (
        counted.join(F.broadcast(few), "ordinal").withColumn("pos", pos)
        .select(names.alias("column"), lane_text().alias("option"))
    )


def global_filters(df: DataFrame, first: int = 5) -> DataFrame:
    """Filters a dashboard offers: date ranges, and pick lists of strings with few values."""
    infos = columns_of(df)
    strings = [c for c in infos if c.kind == "string"]
    dated = {c.ordinal for c in infos if any(w in c.name.lower() for w in ("date", "time"))}
    counts = distinct_counts(df, strings) if strings else None
    rows = [
        F.struct(F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column"),
                 F.lit(heading_text(c.name)).alias("label"), F.lit(c.ordinal in dated).alias("dated"),
                 F.lit(c.kind == "string").alias("text"))
        for c in infos
    ]
    one = df.agg(F.count(F.lit(1)).alias("rows"))
    table = one.select(F.inline(F.array(*rows)))
    if counts is not None:
        table = table.join(F.broadcast(counts), "ordinal", "left")
    else:
        table = table.withColumn("distinct", F.lit(None).cast("bigint"))
    pick = F.col("text") & (F.coalesce("distinct", F.lit(0)) < 20)
    return (
        table.withColumn("type", F.when(F.col("dated"), "date_range").when(pick, "multi_select"))
        .where(F.col("type").isNotNull()).orderBy("ordinal").limit(first)
        .select("ordinal", "column", "label", "type")
    )


def errors_only(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Rows whose prediction is wrong; a missing side counts as wrong."""
    return df.where(~F.coalesce(quoted(predicted) == quoted(actual), F.lit(False)))


def severity_rank(col: Column) -> Column:
    ranks = F.create_map(*[F.lit(v) for kv in SEVERITY_RANK.items() for v in kv])
    return F.coalesce(F.try_element_at(ranks, col), F.lit(5))


def insight_page(insights: DataFrame, severity: str | None = None, insight_type: str | None = None,
                 offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of insights that are not dismissed, most urgent and newest first."""
    out = insights.where(~F.col("is_dismissed"))
    if severity:
        out = out.where(F.col("severity") == severity)
    if insight_type:
        out = out.where(F.col("insight_type") == insight_type)
    tie = [c for c in ("created_at", "insight_type", "offering_id") if c in insights.columns]
    order = [F.col("created_at").desc() if c == "created_at" else quoted(c) for c in tie]
    return out.orderBy(severity_rank(F.col("severity")), *order).offset(offset).limit(limit)


def insight_count(insights: DataFrame, severity: str | None = None) -> DataFrame:
    out = insights.where(~F.col("is_dismissed"))
    if severity:
        out = out.where(F.col("severity") == severity)
    return out.agg(F.count(F.lit(1)).alias("total"))


def dismiss(insights: DataFrame, matching: Column) -> DataFrame:
    """Mark the matching insights as dismissed."""
    return insights.withColumn("is_dismissed", F.col("is_dismissed") | F.coalesce(matching, F.lit(False)))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, col: str) -> DataFrame:
    return df.drop(col)


def convert_type(df: DataFrame, col: str, target: str) -> DataFrame:
    """Cast a column; values that do not fit become NULL, an unknown target changes nothing."""
    if col not in df.columns:
        return df
    dtype = df.schema[col].dataType
    source = quoted(col)
    if target == "int":
        whole = source.try_cast("double")
        new = F.when(whole == F.floor(whole), whole).try_cast("bigint")
    elif target == "float":
        new = source.try_cast("double")
    elif target in ("string", "category"):
        new = source.cast("string")
    elif target == "datetime":
        new = to_timestamp_or_null(source, dtype)
    else:
        return df
    return df.withColumn(col, new)


def high_margin(df: DataFrame, floor: float = 0.2) -> DataFrame:
    """Offerings with revenue whose profit share exceeds ``floor``."""
    return df.where((F.col("revenue") > 0) & (ratio(F.col("profit"), F.col("revenue")) > floor))


def feature_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Numeric columns that can serve as features."""
    skip = set(TARGET_NAMES) | {(target or "").lower()}
    return [c for c in numeric_names(df) if c.lower() not in skip and not c.lower().startswith("unnamed")]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Projection to the numeric, string or temporal columns; dates also by name."""
    names = [c.name for c in columns_of(df) if c.kind == kind]
    if kind == "temporal":
        named = [c for c in df.columns if any(w in c.lower() for w in ("date", "time"))]
        names = [c for c in df.columns if c in names or c in named]
    return df.select(*[quoted(c) for c in names])


def column_kinds(df: DataFrame, few: int = 50) -> DataFrame:
    """(ordinal, column, group): numeric, datetime, categorical (under 50 values) or text."""
    infos = [c for c in columns_of(df)]
    strings = [c for c in infos if c.kind == "string"]
    one = df.agg(F.count(F.lit(1)).alias("rows"))
    rows = [
        F.struct(F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column"), F.lit(_group(c)).alias("fixed"))
        for c in infos
    ]
    table = one.select(F.inline(F.array(*rows)))
    if strings:
        table = table.join(F.broadcast(distinct_counts(df, strings)), "ordinal", "left")
    else:
        table = table.withColumn("distinct", F.lit(None).cast("bigint"))
    few_values = F.coalesce("distinct", F.lit(0)) < few
    return table.select(
        "ordinal", "column",
        F.when(F.col("fixed") == "string", F.when(few_values, "categorical").otherwise("text"))
        .otherwise(F.col("fixed")).alias("group"),
    )


def _group(info) -> str:
    if info.kind == "temporal" or any(w in info.name.lower() for w in ("date", "time", "timestamp")):
        return "datetime"
    if info.kind == "numeric":
        return "numeric"
    return "string" if info.kind == "string" else "other"
