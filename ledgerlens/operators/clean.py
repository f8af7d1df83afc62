"""Cleaning operations: gaps, outliers, duplicates, types, formulas.

An operation is a ``Cleaning`` record; ``apply`` folds a list of them over a
DataFrame.  Constants that come from the data (a mean, a fence) are read as one
row and become literals: a fold of many operations is then one flat projection
over the scan instead of subqueries nested inside subqueries.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.numbers import is_numeric, rounded
from ledgerlens.functions.text import quoted
from ledgerlens.operators.filters import convert_type, drop_column, rename_column
from ledgerlens.plans.catalog import columns_of, frequencies, local_table
from ledgerlens.plans.ordered import ROWS_PER_SLICE, with_neighbours
from ledgerlens.plans.ranks import Quantile, quantile_exprs, quantile_row


@dataclass(frozen=True)
class Cleaning:
    """One requested operation; unused fields stay None."""

    type: str
    column: str | None = None
    method: str | None = None
    custom_value: Any = None
    formula: str | None = None
    new_name: str | None = None
    target_type: str | None = None

    @property
    def kind(self) -> str:
        return self.type.lower().replace(" ", "_")


def _known(one_row: DataFrame) -> list[Column]:
    """The cells of a one-row result as literals of their types; empty without a row."""
    row = one_row.first()
    if row is None:
        return []
    return [F.lit(v).cast(f.dataType) for v, f in zip(row, one_row.schema.fields)]


def _numeric(df: DataFrame, column: str | None) -> bool:
    return column in df.columns and is_numeric(df.schema[column].dataType)


def _fill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Fill gaps; an integer column filled with a fraction becomes a double."""
    dtype = df.schema[column].dataType
    source = quoted(column)
    if is_numeric(dtype):
        return df.withColumn(column, F.coalesce(source.cast("double"), value.cast("double")))
    return df.withColumn(column, F.coalesce(source, value.cast(dtype)))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return _fill(df, column, _known(df.agg(F.avg(quoted(column).cast("double"))))[0])


def fill_median(df: DataFrame, column: str) -> DataFrame:
    return _fill(df, column, _known(quantile_row(df, [Quantile("m", quoted(column), 0.5)]))[0])


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """One row with the most frequent value, the smallest one on ties."""
    return (
        df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "v").limit(1).select("v")
    )


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    mode = _known(mode_value(df, column))
    return _fill(df, column, mode[0]) if mode else df


def fill_constant(df: DataFrame, column: str, value: Any) -> DataFrame:
    if value is None:
        return df
    dtype = df.schema[column].dataType
    return df.withColumn(column, F.coalesce(quoted(column), F.lit(value).try_cast(dtype)))


def fill_previous(df: DataFrame, column: str, order_by: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Carry the last filled value forward in row order."""
    rows = with_neighbours(df, [column], order_by, backward=False, rows_per_slice=rows_per_slice)
    return _tidy(rows.withColumn(column, quoted(f"_prev_{column}")["value"]), df)


def fill_next(df: DataFrame, column: str, order_by: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Carry the next filled value backward in row order."""
    rows = with_neighbours(df, [column], order_by, forward=False, rows_per_slice=rows_per_slice)
    return _tidy(rows.withColumn(column, quoted(f"_next_{column}")["value"]), df)


def interpolate(df: DataFrame, column: str, order_by: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Straight line between filled neighbours by row position; the tail repeats the last value."""
    rows = with_neighbours(df, [column], order_by, rows_per_slice=rows_per_slice)
    prev, nxt = quoted(f"_prev_{column}"), quoted(f"_next_{column}")
    a, b = prev["value"].cast("double"), nxt["value"].cast("double")
    between = a + (b - a) * (F.col("_rn") - prev["_rn"]) / (nxt["_rn"] - prev["_rn"])
    value = F.when(quoted(column).isNotNull(), quoted(column).cast("double")).when(nxt.isNull(), a).otherwise(between)
    return _tidy(rows.withColumn(column, value), df)


def _tidy(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[quoted(c) for c in like.columns])


def fill_missing(df: DataFrame, column: str, method: str, custom_value: Any = None, order_by: str | None = None) -> DataFrame:
    """Treat the gaps of one column; an unknown method keeps them."""
    if column not in df.columns:
        return df
    if method in ("interpolate", "ffill", "bfill"):
        if order_by is None:
            raise ValueError(f"{method} needs the column that orders the rows")
        step = {"interpolate": interpolate, "ffill": fill_previous, "bfill": fill_next}[method]
        return step(df, column, order_by)
    if method == "drop":
        return df.dropna(subset=[column])
    if method == "fill_mean":
        return fill_mean(df, column)
    if method == "fill_median":
        return fill_median(df, column)
    if method == "fill_mode":
        return fill_mode(df, column)
    constants = {"fill_zero": 0, "fill_unknown": "Unknown", "fill_custom": custom_value}
    return fill_constant(df, column, constants[method]) if method in constants else df


def _ends(df: DataFrame, column: str, low: float, high: float) -> tuple[Column, Column]:
    lo, hi = _known(quantile_row(df, [Quantile("lo", quoted(column), low), Quantile("hi", quoted(column), high)]))
    return lo, hi


def _fences(df: DataFrame, column: str) -> tuple[Column, Column]:
    """1.5 interquartile ranges beyond the quartiles."""
    q1, q3 = _ends(df, column, 0.25, 0.75)
    iqr = q3 - q1
    return q1 - 1.5 * iqr, q3 + 1.5 * iqr


def _clip(value: Column, low: Column, high: Column) -> Column:
    """Nulls stay null, unlike with greatest and least."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def treat_outliers(df: DataFrame, column: str, method: str) -> DataFrame:
    """Remove, clip or replace outliers of a numeric column; rows without a value are kept."""
    if not _numeric(df, column):
        return df
    value = quoted(column).cast("double")
    if method == "cap_percentile":
        return df.withColumn(column, _clip(value, *_ends(df, column, 0.01, 0.99)))
    if method not in ("remove", "cap_iqr", "replace_mean", "replace_median"):
        return df
    low, high = _fences(df, column)
    outlying = (value < low) | (value > high)
    if method == "remove":
        return df.where(value.isNull() | ~outlying)
    if method == "cap_iqr":
        return df.withColumn(column, _clip(value, low, high))
    inside = df.where(value.isNotNull() & ~outlying)
    middle = _known(inside.agg(F.avg(value)) if method == "replace_mean" else quantile_row(inside, [Quantile("m", value, 0.5)]))
    return df.withColumn(column, F.when(outlying, middle[0]).otherwise(value))


def drop_duplicates(df: DataFrame, keep: str = "first", order_by: str | None = None, subset: list[str] | None = None) -> DataFrame:
    """One row per distinct content, the first or last in row order.

    The winner is a min_by / max_by over the order column, so copies are reduced
    before the shuffle and no task has to hold all copies of a row.
    """
    keys = subset or [c for c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    if order_by is None or not rest:
        return df.dropDuplicates(keys)
    pick = F.max_by if keep == "last" else F.min_by
    grouped = df.groupBy(*[quoted(k) for k in keys]).agg(
        pick(F.struct(*[quoted(c) for c in rest]), quoted(order_by)).alias("_row")
    )
    return grouped.select(*[quoted(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def treat_duplicates(df: DataFrame, method: str, order_by: str | None = None, subset: list[str] | None = None) -> DataFrame:
    if method in ("drop_duplicates", "keep_first"):
        return drop_duplicates(df, "first", order_by, subset)
    if method == "keep_last":
        return drop_duplicates(df, "last", order_by, subset)
    return df


def log_transform(df: DataFrame, column: str) -> DataFrame:
    value = quoted(column).cast("double")
    return df.withColumn(column, F.when(value > -1, F.log1p(value)))


def sqrt_transform(df: DataFrame, column: str) -> DataFrame:
    value = quoted(column).cast("double")
    return df.withColumn(column, F.when(value >= 0, F.sqrt(value)))


def custom_formula(df: DataFrame, column: str, formula: str) -> tuple[DataFrame, str | None]:
    """Set a column to a SQL expression over the row; a bad one changes nothing and is reported.

    Only an expression is accepted, never code.
    """
    try:
        out = df.withColumn(column, F.expr(formula))
        out.schema  # resolve now, so that errors surface here
        return out, None
    except (AnalysisException, ParseException) as error:
        return df, f"Error: {error.getCondition() or type(error).__name__}"


def default_impute(df: DataFrame) -> DataFrame:
    """Gaps in numbers become the column median, gaps in text become ``Unknown``."""
    numeric = [c.name for c in columns_of(df, "numeric")]
    strings = [c.name for c in columns_of(df, "string")]
    out = df
    if numeric:
        medians = quantile_row(df, [Quantile(f"m{i}", quoted(c), 0.5) for i, c in enumerate(numeric)])
        known = _known(medians)
        out = out.withColumns({c: F.coalesce(quoted(c).cast("double"), m) for c, m in zip(numeric, known)})
    return out.fillna("Unknown", subset=strings) if strings else out


def apply_one(df: DataFrame, op: Cleaning, order_by: str | None = None) -> DataFrame:
    """One operation; unknown kinds and missing columns change nothing."""
    if op.kind == "missing_values":
        return fill_missing(df, op.column, op.method, op.custom_value, order_by)
    if op.kind == "outliers":
        return treat_outliers(df, op.column, op.method)
    if op.kind in ("skewed_distribution", "custom_formula"):
        if op.formula and op.column:
            return custom_formula(df, op.column, op.formula)[0]
        if op.method == "log_transform":
            return log_transform(df, op.column)
        return sqrt_transform(df, op.column) if op.method == "sqrt_transform" else df
    if op.kind == "duplicates":
        return treat_duplicates(df, op.method, order_by)
    if op.kind == "rename":
        return rename_column(df, op.column, op.new_name)
    if op.kind == "drop_column":
        return drop_column(df, op.column)
    if op.kind == "convert_type":
        return convert_type(df, op.column, op.target_type)
    return df


def apply(df: DataFrame, operations: list[Cleaning], order_by: str | None = None) -> DataFrame:
    """Fold the operations over the table, in order."""
    for op in operations:
        df = apply_one(df, op, order_by)
    return df


def apply_with_report(df: DataFrame, operations: list[Cleaning], order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, and what each operation did to it (see ``preview``)."""
    return apply(df, operations, order_by), preview(df, operations, order_by)


def affected(df: DataFrame, op: Cleaning) -> DataFrame:
    """(rows, affected): rows before an operation and how many it concerns."""
    if op.kind == "duplicates":
        groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                          F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("affected"))
    if op.column is not None and op.column not in df.columns:
        hit = F.lit(False)
    elif op.kind == "missing_values":
        hit = quoted(op.column).isNull()
    elif op.kind == "outliers" and _numeric(df, op.column):
        low, high = _fences(df, op.column)
        value = quoted(op.column).cast("double")
        hit = F.coalesce((value < low) | (value > high), F.lit(False))
    else:
        hit = F.lit(op.kind != "outliers")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("affected"))


STATE = ("nulls", "unique", "mean", "median", "min", "max")


def column_state(df: DataFrame, column: str) -> DataFrame:
    """One row of statistics of a column: nulls, unique, mean, median, min, max."""
    info = [c for c in columns_of(df) if c.name == column]
    unique = frequencies(df, info).agg(F.count(F.lit(1))).scalar()
    v = quoted(column).cast("double") if _numeric(df, column) else F.lit(None).cast("double")
    numbers = [rounded(F.avg(v), 4).alias("mean"), rounded(F.min(v), 4).alias("min"), rounded(F.max(v), 4).alias("max")]
    median = quantile_exprs(df, [Quantile("median", v, 0.5)])
    row = df.agg(F.count_if(quoted(column).isNull()).alias("nulls"), *numbers, *median)
    return row.select("nulls", unique.alias("unique"), "mean", rounded(F.col("median"), 4).alias("median"), "min", "max")


def _state_row(df: DataFrame, column: str | None) -> tuple:
    if column is None or column not in df.columns:
        return (None,) * len(STATE)
    return tuple(column_state(df, column).first())


def preview(df: DataFrame, operations: list[Cleaning], order_by: str | None = None) -> DataFrame:
    """One row per operation: rows concerned and the column before and after; nothing is stored.

    Each intermediate table is summarised by one-row aggregates, so the report
    has as many rows as there are operations whatever the size of the data.
    """
    report = []
    current, seen = df, {}
    for step, op in enumerate(operations, start=1):
        after = apply_one(current, op, order_by)
        rows, hit = affected(current, op).first()
        before_state = seen.get(op.column) or _state_row(current, op.column)
        after_state = _state_row(after, op.column)
        seen = {op.column: after_state}
        report.append((step, op.kind, op.column, op.method, hit, rows, *before_state, *after_state))
        current = after
    last = current.count()
    after_rows = [line[5] for line in report[1:]] + [last]
    types = {"nulls": "bigint", "unique": "bigint"}
    state = [f"{tag}_{k} {types.get(k, 'double')}" for tag in ("before", "after") for k in STATE]
    schema = ", ".join([
        "step int", "operation string", "`column` string", "method string", "rows_affected bigint", "rows_before bigint",
        *state, "rows_after bigint",
    ])
    return local_table(df.sparkSession, [(*line, n) for line, n in zip(report, after_rows)], schema)


def preview_rows(df: DataFrame, operations: list[Cleaning], order_by: str, n: int = 20) -> DataFrame:
    """First rows of the cleaned table."""
    return apply(df, operations, order_by).orderBy(quoted(order_by)).limit(n)
