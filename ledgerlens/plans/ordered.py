"""Whole-table order without a whole-table window.

A window without PARTITION BY moves every row to one task.  Here a table is cut into slices along its order
key by range: keys are compared whole, so any key that sorts gives even slices, long common prefixes and
rows of equal keys included.  Windows then run per slice, and what crosses a border (running totals, last
seen values) is summarised to one row per slice.  Those summaries are scanned on two levels: inside chunks of
slices, then over the chunks' own summaries, so that no window grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ledgerlens.functions.dates import is_temporal
from ledgerlens.functions.text import quoted
from ledgerlens.session import ensure_checkpoint_dir

ROWS_PER_SLICE = 2_000_000
#: Slices whose summaries one window scans; up to as many summary rows are broadcast.
SLICES_PER_CHUNK = 1024
SLICE, CHUNK, TIE = "_slice", "_chunk", "_tie"
BEFORE = (Window.unboundedPreceding, -1)


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _cut(df: DataFrame, key: str, rows_per_slice: int) -> tuple[DataFrame, int]:
    """Rows with their slice and a digest that orders rows of equal keys; and the number of slices.

    More than one slice is staged: the range exchange samples the keys, and every later use must see one cut.
    """
    dtype = df.schema[key].dataType
    if not (is_temporal(dtype) or isinstance(dtype, (T.NumericType, T.StringType, T.BinaryType))):
        raise TypeError(f"order key {key} must be numeric, temporal, text or binary, not {dtype.simpleString()}")
    wanted = math.ceil(df.count() / rows_per_slice)
    if wanted <= 1:
        return df.withColumns({SLICE: F.lit(0), TIE: F.lit(0).cast("bigint")}), 1
    digested = [quoted(f.name) for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    marked = df.withColumn(TIE, F.xxhash64(*digested))
    parts = marked.repartitionByRange(wanted, quoted(key).asc_nulls_first(), F.col(TIE)).withColumn(SLICE, F.spark_partition_id())
    return staged(parts), wanted


def sliced(df: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add the slice number of every row.  Slices are ordered like ``key`` and hold about as many rows each."""
    return _cut(df, key, rows_per_slice)[0].drop(TIE)


def _along(key: str, descending: bool = False, within: tuple[str, ...] = ()):
    """Window over the rows of a slice in order; rows of equal keys have one order in every use."""
    order = [quoted(key), F.col(TIE)]
    return Window.partitionBy(SLICE, *within).orderBy(*[c.desc() if descending else c.asc() for c in order])


_BOTH: dict[Callable, Callable[[Column, Column], Column]] = {
    F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.max: F.greatest, F.min: F.least}


def _carried(summary: DataFrame, measures: dict[str, tuple[Callable, str]], slices: int, backward: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """What the slices before each slice (after it, if ``backward``) come to: ``measures`` maps outputs to an aggregate and its column."""
    def scan(rows: DataFrame, place: str, groups: tuple[str, ...]) -> DataFrame:
        order = F.col(place).desc() if backward else F.col(place).asc()
        along = (Window.partitionBy(*groups) if groups else Window).orderBy(order).rowsBetween(*BEFORE)
        return rows.withColumns({out: fn(quoted(out)).over(along) for out, (fn, _) in measures.items()})

    rows = summary.select(SLICE, *within, *[quoted(src).alias(out) for out, (_, src) in measures.items()])
    if slices <= SLICES_PER_CHUNK:
        return scan(rows, SLICE, within)
    rows = rows.withColumn(CHUNK, F.floor(F.col(SLICE) / SLICES_PER_CHUNK).cast("int"))
    tops = scan(rows.groupBy(CHUNK, *within).agg(*[fn(quoted(out)).alias(out) for out, (fn, _) in measures.items()]), CHUNK, within)
    same = F.col("i." + CHUNK) == F.col("t." + CHUNK)
    for c in within:
        same = same & F.col(f"i.`{c}`").eqNullSafe(F.col(f"t.`{c}`"))
    both = scan(rows, SLICE, (CHUNK, *within)).alias("i").join(tops.alias("t"), same)
    return both.select(
        F.col("i." + SLICE), *[F.col(f"i.`{c}`") for c in within],
        *[_BOTH[fn](F.col(f"i.`{out}`"), F.col(f"t.`{out}`")).alias(out) for out, (fn, _) in measures.items()])


def _joined(parts: DataFrame, carried: DataFrame, slices: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows beside what is carried into their slice; only a summary of one row for each of few slices is broadcast."""
    names = {c: f"_of_{i}" for i, c in enumerate((SLICE, *within))}
    side = carried.select(*[quoted(c).alias(names[c]) if c in names else quoted(c) for c in carried.columns])
    if slices <= SLICES_PER_CHUNK and not within:
        side = F.broadcast(side)
    same = F.col(SLICE) == F.col(names[SLICE])
    for c in within:
        same = same & quoted(c).eqNullSafe(F.col(names[c]))
    return parts.join(side, same).drop(*names.values())


def running_totals(
    df: DataFrame,
    key: str,
    measures: dict[str, str],
    descending: bool = False,
    within: tuple[str, ...] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Inclusive running total of each measure along ``key``.

    ``measures`` maps output names to input columns.  ``key`` must be unique, or
    unique per value of ``within``, a few groups that each run on their own.
    """
    parts, slices = _cut(df, key, rows_per_slice)
    running = _along(key, descending, within).rowsBetween(Window.unboundedPreceding, 0)
    own = {out: F.sum(quoted(src)).over(running) for out, src in measures.items()}
    if slices > 1:
        summary = parts.groupBy(SLICE, *within).agg(*[F.sum(quoted(src)).alias(f"_t_{out}") for out, src in measures.items()])
        carried = _carried(summary, {f"_o_{out}": (F.sum, f"_t_{out}") for out in measures}, slices, descending, within)
        parts = _joined(parts, carried, slices, within)
        own = {out: total + F.coalesce(quoted(f"_o_{out}"), F.lit(0)) for out, total in own.items()}
    return parts.withColumns(own).drop(SLICE, TIE, *[f"_o_{out}" for out in measures])


def _numbered(df: DataFrame, key: str, rows_per_slice: int) -> tuple[DataFrame, int]:
    parts, slices = _cut(df, key, rows_per_slice)
    own = F.row_number().over(_along(key)).cast("bigint")
    if slices > 1:
        counts = parts.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_n"))
        parts = _joined(parts, _carried(counts, {"_o": (F.sum, "_n")}, slices), slices)
        own = own + F.coalesce("_o", F.lit(0))
    return parts.withColumn("_rn", own).drop("_o", TIE), slices


def numbered(df: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``_rn``, the 1-based row number along ``key``; keeps the slice column."""
    return _numbered(df, key, rows_per_slice)[0]


def with_neighbours(
    df: DataFrame, columns: list[str], key: str, forward: bool = True, backward: bool = True,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Nearest non-null value of each column before and after every row.

    Adds ``_prev_<c>`` (this row or an earlier one) and ``_next_<c>`` (this row
    or a later one) as structs ``(_rn, value)``, plus ``_rn`` and the slice.
    """
    rows, slices = _numbered(df, key, rows_per_slice)
    seen = {c: F.when(quoted(c).isNotNull(), F.struct(F.col("_rn"), quoted(c).alias("value"))) for c in columns}
    # the later side runs over the reversed order; a frame that ends at unbounded following is quadratic
    sides = [("prev", F.max, False)] * forward + [("next", F.min, True)] * backward
    carried: list[str] = []
    for side, fn, reverse in sides if slices > 1 else ():
        edges = rows.groupBy(SLICE).agg(*[fn(seen[c]).alias(c) for c in columns])
        names = {f"_in_{side}_{c}": (fn, c) for c in columns}
        rows = _joined(rows, _carried(edges, names, slices, reverse), slices)
        carried += names
    new = {}
    for side, _, reverse in sides:
        order = F.col("_rn").desc() if reverse else F.col("_rn").asc()
        near = Window.partitionBy(SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        for c in columns:
            own = F.last(seen[c], ignorenulls=True).over(near)
            new[f"_{side}_{c}"] = F.coalesce(own, quoted(f"_in_{side}_{c}")) if slices > 1 else own
    return rows.withColumns(new).drop(*carried)
