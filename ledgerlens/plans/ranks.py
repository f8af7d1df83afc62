"""Exact quantiles at any size.

Small tables use the built-in ``percentile`` aggregate, whose value-to-count map
is bounded by ``EXACT_IN_MEMORY`` rows; all quantiles of a column share one map.
Larger ones are answered by narrowing: a quantile sketch brackets every wanted
order statistic, one scan counts the rows below, at and inside the brackets, and
the few values left inside are read off their exact counts.  Brackets that still
hold many rows are narrowed again.  Counting decides every step, so a sketch that
misses costs another round and never a wrong result; heavy values are found as
bracket ends.  Both ways give the same linear-interpolated quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT_IN_MEMORY = 100_000
SKETCH_ACCURACY = 10_000
ROWS_PER_BRACKET = 1_000_000
NAN = float("nan")


@dataclass(frozen=True)
class Quantile:
    """One wanted quantile: output name, numeric expression, fraction."""

    name: str
    value: Column
    fraction: float


def quantile_exprs(
    df: DataFrame, wanted: list[Quantile], in_memory: int | None = None, rows: int | None = None
) -> list[Column]:
    """Exact quantiles of ``df`` as columns usable in one of its aggregates.

    They join the caller's other aggregates in the same scan while the table is
    small enough; for a larger one they are literals found beforehand.
    """
    if not wanted:
        return []
    rows = df.count() if rows is None else rows
    if rows <= (EXACT_IN_MEMORY if in_memory is None else in_memory):
        shared: dict[str, list[float]] = {}
        for q in wanted:
            shared.setdefault(str(q.value), []).append(q.fraction)
        return [
            F.percentile(q.value.cast("double"), F.array(*[F.lit(p) for p in shared[str(q.value)]]))[
                shared[str(q.value)].index(q.fraction)].alias(q.name)
            for q in wanted
        ]
    values = _narrowed(df, wanted)
    return [F.lit(values[q.name]).cast("double").alias(q.name) for q in wanted]


def quantile_row(df: DataFrame, wanted: list[Quantile], in_memory: int | None = None) -> DataFrame:
    """One-row DataFrame with an exact quantile per entry of ``wanted``."""
    return df.agg(*quantile_exprs(df, wanted, in_memory))


def _plain(value: float) -> float:
    """One object for every NaN, so that bounds can be looked up."""
    return NAN if math.isnan(value) else value


def _less(a: float, b: float) -> bool:
    """Order of the database: NaN is the largest number."""
    return not math.isnan(a) and (math.isnan(b) or a < b)


def _inside(value: Column, low: float | None, high: float | None) -> Column:
    test = value.isNotNull()
    if low is not None:
        test = test & (value > low)
    return test if high is None else test & (value < high)


@dataclass
class _Target:
    """An order statistic on its way: rank ``rank`` of column ``col`` lies in (low, high) or at an end of (a, b)."""

    col: str
    rank: int
    low: float | None = None   # no bound yet
    high: float | None = None
    below: int = 0   # rows at or below ``low``
    inside: int = 0  # rows in (low, high)
    a: float = 0.0
    b: float = 0.0


def _narrowed(df: DataFrame, wanted: list[Quantile]) -> dict[str, float | None]:
    """Quantiles of a large table; the driver sees bounds and counts only."""
    cols = {str(q.value): q.value.cast("double") for q in wanted}
    margin = 2.0 / SKETCH_ACCURACY
    ends = {c: sorted({min(1.0, max(0.0, q.fraction + side)) for q in wanted if str(q.value) == c for side in (-margin, margin)}) for c in cols}
    names = {c: i for i, c in enumerate(cols)}
    first = df.agg(*[F.count(e).alias(f"n{names[c]}") for c, e in cols.items()], *[
        F.percentile_approx(e, ends[c], F.lit(SKETCH_ACCURACY)).alias(f"s{names[c]}") for c, e in cols.items()]).first()
    targets: dict[tuple[str, int], _Target] = {}
    for q in wanted:
        c = str(q.value)
        n, sketch = first[f"n{names[c]}"], first[f"s{names[c]}"]
        if n:
            at = q.fraction * (n - 1)
            a, b = (_plain(sketch[ends[c].index(min(1.0, max(0.0, q.fraction + side)))]) for side in (-margin, margin))
            for rank in {math.floor(at), math.ceil(at)}:
                targets.setdefault((c, rank), _Target(c, rank, inside=n, a=a, b=b))
    found = _order_statistics(df, cols, list(targets.values()))
    result: dict[str, float | None] = {}
    for q in wanted:
        c = str(q.value)
        n = first[f"n{names[c]}"]
        if not n:
            result[q.name] = None
            continue
        at = q.fraction * (n - 1)
        low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
        share = at - math.floor(at)
        # as the built-in aggregate does it, so that infinite ends and NaN give the same at any size
        result[q.name] = low if low == high or share == 0 else (1 - share) * low + share * high
    return result


def _order_statistics(df: DataFrame, cols: dict[str, Column], pending: list[_Target]) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    ready: list[_Target] = []
    while pending:
        pending = _count_brackets(df, cols, pending, found, ready)
        if pending:
            _sketch_brackets(df, cols, pending)
    found.update(_read_off(df, cols, ready))
    return found


def _count_brackets(df, cols, pending: list[_Target], found: dict, ready: list[_Target]) -> list[_Target]:
    """Place every target by exact counts: at a, at b, inside (a, b) or outside; return those still too wide."""
    spans = list(dict.fromkeys((t.col, t.a, t.b) for t in pending))
    counts = df.agg(*[
        F.count(F.when(condition, 1)).alias(f"{k}{i}")
        for i, (c, a, b) in enumerate(spans)
        for k, condition in (("lt", cols[c] < a), ("at", cols[c] == a), ("in", (cols[c] > a) & (cols[c] < b)), ("up", cols[c] == b))
        if _less(a, b) or k in ("lt", "at")
    ]).first()
    wide = []
    for t in pending:
        i = spans.index((t.col, t.a, t.b))
        lt, at = counts[f"lt{i}"], counts[f"at{i}"]
        inner, up = (counts[f"in{i}"], counts[f"up{i}"]) if _less(t.a, t.b) else (0, 0)
        if lt <= t.rank < lt + at:
            found[t.col, t.rank] = t.a
            continue
        if lt + at + inner <= t.rank < lt + at + inner + up:
            found[t.col, t.rank] = t.b
            continue
        if t.rank < lt:
            t.high, t.inside = t.a, lt - t.below
        elif t.rank < lt + at + inner:
            t.low, t.high, t.below, t.inside = t.a, t.b, lt + at, inner
        else:
            t.low, t.inside = t.b, t.inside - (lt + at + inner + up - t.below)
            t.below = lt + at + inner + up
        (ready if t.inside <= ROWS_PER_BRACKET else wide).append(t)
    return wide


def _sketch_brackets(df, cols, pending: list[_Target]) -> None:
    """New bracket ends from a sketch of the rows inside each bracket."""
    margin = 2.0 / SKETCH_ACCURACY
    exprs = []
    for i, t in enumerate(pending):
        value = F.when(_inside(cols[t.col], t.low, t.high), cols[t.col])
        local = (t.rank - t.below) / max(t.inside - 1, 1)
        exprs.append(F.percentile_approx(value, [max(0.0, local - margin), min(1.0, local + margin)], F.lit(SKETCH_ACCURACY)).alias(f"b{i}"))
    row = df.agg(*exprs).first()
    for i, t in enumerate(pending):
        t.a, t.b = map(_plain, row[f"b{i}"])


def _read_off(df: DataFrame, cols: dict[str, Column], ready: list[_Target]) -> dict[tuple[str, int], float]:
    """Values of the targets whose brackets hold few rows."""
    if not ready:
        return {}
    spans = list(dict.fromkeys((t.col, t.low, t.high) for t in ready))
    tagged = [
        F.when(_inside(cols[c], low, high), F.struct(F.lit(i).alias("span"), cols[c].alias("value")))
        for i, (c, low, high) in enumerate(spans)
    ]
    in_any = tagged[0].isNotNull()
    for x in tagged[1:]:
        in_any = in_any | x.isNotNull()
    counted = (
        df.where(in_any).select(F.explode(F.array_compact(F.array(*tagged))).alias("v"))
        .groupBy(F.col("v.span").alias("span"), F.col("v.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    ranks = [sorted({t.rank - t.below for t in ready if (t.col, t.low, t.high) == span}) for span in spans]
    of_span = F.element_at(F.array(*[F.array(*[F.lit(r).cast("bigint") for r in rs]) for rs in ranks]), F.col("span") + 1)
    upto = Window.partitionBy("span").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counted.withColumn("upto", F.sum("n").over(upto))
        .where(F.exists(of_span, lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)))
        .select("span", "value", "n", "upto").collect()
    )
    out = {}
    for t in ready:
        i, rank = spans.index((t.col, t.low, t.high)), t.rank - t.below
        out[t.col, t.rank] = next(h["value"] for h in hits if h["span"] == i and h["upto"] - h["n"] <= rank < h["upto"])
    return out
