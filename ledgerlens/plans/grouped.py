"""Exact quantiles of many groups in one run.

Groups of up to ``EXACT_IN_MEMORY`` rows use the built-in aggregate, whose value-to-count map they bound.
Larger groups are narrowed together, whatever their number: a quantile sketch of each group brackets every
wanted order statistic, one aggregate counts the group's rows below, at and inside its brackets, and the few
values left inside are read off their counts.  Brackets that still hold many rows go through another round.
The state of all order statistics is a table of its own; the driver learns only whether any is left.
A round is a scan with map-side combined sums, so a group that holds most rows is no group of one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.text import quoted
from ledgerlens.plans.ordered import staged
from ledgerlens.plans.ranks import EXACT_IN_MEMORY, ROWS_PER_BRACKET, Quantile

#: Size of a group's sketch, and cells of the grid of quantiles that brackets are taken from.
SKETCH, GRID = 4096, 512
#: State tables of up to as many rows are broadcast to the rows of their groups.
BROADCAST_ROWS = 100_000


def _matched(rows: DataFrame, state: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows beside the state of their group; nulls are keys too."""
    side = state.withColumnsRenamed({k: f"{k}s" for k in keys})
    if state.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys])
    return rows.join(side, same, how).drop(*[f"{k}s" for k in keys])


def grouped_quantiles(df: DataFrame, by: list[str], wanted: list[Quantile], in_memory: int | None = None, per_bracket: int | None = None) -> DataFrame:
    """A row for each group of ``by`` with an exact quantile for each entry of ``wanted`` (null without values)."""
    in_memory = EXACT_IN_MEMORY if in_memory is None else in_memory
    per_bracket = ROWS_PER_BRACKET if per_bracket is None else per_bracket
    keys = [f"_g{i}" for i in range(len(by))]
    exprs = list(dict.fromkeys(str(q.value) for q in wanted))
    place = {i: exprs.index(str(q.value)) for i, q in enumerate(wanted)}
    values = {str(q.value): q.value for q in wanted}
    slim = df.select(*[quoted(c).alias(k) for c, k in zip(by, keys)], *[values[e].cast("double").alias(f"_v{j}") for j, e in enumerate(exprs)])
    names = {k: c for k, c in zip(keys, by)}
    fractions = {j: sorted({q.fraction for i, q in enumerate(wanted) if place[i] == j}) for j in range(len(exprs))}

    def small(rows: DataFrame) -> DataFrame:
        read = [F.percentile(f"_v{j}", F.array(*[F.lit(f) for f in fractions[j]])).alias(f"_p{j}") for j in range(len(exprs))]
        cells = [F.col(f"_p{place[i]}")[fractions[place[i]].index(q.fraction)].alias(q.name) for i, q in enumerate(wanted)]
        return rows.groupBy(*keys).agg(*read).select(*keys, *cells)

    large = staged(slim.groupBy(*keys).count().filter(F.col("count") > in_memory).select(*keys, F.lit(True).alias("_large")))
    if not large.take(1):
        return small(slim).withColumnsRenamed(names)
    marked = _matched(slim, large, keys, "left")
    rest = small(marked.filter("_large is null").drop("_large"))
    rows = marked.filter("_large").select(*keys, F.inline(F.array(*[F.struct(F.lit(j).alias("_c"), F.col(f"_v{j}").alias("_v")) for j in range(len(exprs))])))
    rows = rows.filter("_v is not null")
    told = _narrowed(rows, [*keys, "_c"], {j: fractions[j] for j in range(len(exprs))}, per_bracket)
    cells = [F.max(F.when((F.col("_c") == place[i]) & (F.col("_f") == q.fraction), F.col("_value"))).alias(q.name) for i, q in enumerate(wanted)]
    found = _matched(large.select(*keys), staged(told.groupBy(*keys).agg(*cells)), keys, "left")
    return rest.unionByName(found).withColumnsRenamed(names)


def _narrowed(rows: DataFrame, keys: list[str], fractions: dict[int, list[float]], per_bracket: int) -> DataFrame:
    """(keys, _f, _value): quantiles of the values ``_v`` of each group, for the fractions of its column ``_c``."""
    sizes = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.isnan("_v")).alias("_m")))
    asked = F.array(*[F.struct(F.lit(j).alias("c"), F.lit(f).alias("_f")) for j, fs in fractions.items() for f in fs])
    spots = sizes.select(*keys, "_n", "_m", F.explode(F.filter(asked, lambda a: a["c"] == F.col("_c"))).alias("a")).select(
        *keys, "_n", "_m", F.col("a._f").alias("_f"), (F.col("a._f") * (F.col("_n") - 1)).alias("_at"))
    both = spots.select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    # NaN is the largest number and in no sketch: ranks past the others are NaN
    solved = both.filter("_rank >= _m").select(*keys, "_rank", F.lit(float("nan")).alias("_value")).distinct()
    open_ = staged(both.filter("_rank < _m").select(*keys, "_rank", none.alias("_low"), none.alias("_high"), zero.alias("_below"),
                                                    F.col("_m").alias("_inside")).distinct())
    numbers = rows.filter(~F.isnan("_v"))
    v = F.col("_v")
    inner = (F.col("_low").isNull() | (v > F.col("_low"))) & (F.col("_high").isNull() | (v < F.col("_high")))
    ready = None
    state = [*keys, "_rank", "_low", "_high", "_below", "_inside"]
    while open_.take(1):
        few = open_.filter(F.col("_inside") <= per_bracket)
        ready = few if ready is None else ready.unionByName(few)
        wide = open_.filter(F.col("_inside") > per_bracket)
        # equal brackets share one sketch and one row for each row inside
        spans = [*keys, "_low", "_high", "_below", "_inside"]
        grids = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("_v", F.lit(SKETCH)), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        sketched = staged(_matched(numbers, wide.select(*spans).distinct(), keys).filter(inner).groupBy(*spans).agg(grids.alias("_grid")))
        local = (F.col("_rank") - F.col("_below")) / F.greatest(F.col("_inside") - 1, F.lit(1))
        cell = F.floor(local * GRID).cast("int")
        ends = _matched(wide, sketched.select(*keys, F.col("_low").alias("_l"), F.col("_high").alias("_h"), "_grid"), keys).filter(
            F.col("_low").eqNullSafe(F.col("_l")) & F.col("_high").eqNullSafe(F.col("_h"))).select(
            *state, F.col("_grid")[F.greatest(cell - 1, F.lit(0))].alias("_a"), F.col("_grid")[F.least(cell + 2, F.lit(GRID))].alias("_b"))
        a, b = F.col("_a"), F.col("_b")
        counted = staged(_matched(numbers, ends, keys).filter(inner).groupBy(*state, "_a", "_b").agg(
            F.count_if(v < a).alias("_lt"), F.count_if(v == a).alias("_eq"), F.count_if((v > a) & (v < b)).alias("_in"),
            F.count_if((v == b) & (b > a)).alias("_up")))
        r, lt = F.col("_rank") - F.col("_below"), F.col("_lt")
        upto_a = lt + F.col("_eq")
        upto_in = upto_a + F.col("_in")
        upto_b = upto_in + F.col("_up")
        at_a, at_b = (r >= lt) & (r < upto_a), (r >= upto_in) & (r < upto_b)
        solved = solved.unionByName(counted.filter(at_a | at_b).select(*keys, "_rank", F.when(at_a, a).otherwise(b).alias("_value")))
        first, middle = r < lt, (r >= upto_a) & (r < upto_in)
        moved = counted.filter(~(at_a | at_b)).select(
            *keys, "_rank", F.when(first, F.col("_low")).when(middle, a).otherwise(b).alias("_low"),
            F.when(first, a).when(middle, b).otherwise(F.col("_high")).alias("_high"),
            (F.col("_below") + F.when(first, 0).when(middle, upto_a).otherwise(upto_b)).alias("_below"),
            F.when(first, lt).when(middle, F.col("_in")).otherwise(F.col("_inside") - upto_b).alias("_inside"))
        open_ = staged(moved)
    if ready is not None:
        solved = solved.unionByName(_read_off(numbers, staged(ready), keys, inner))
    places = _matched(spots, staged(solved).withColumnRenamed("_rank", "_r"), keys).filter((F.col("_r") == F.floor("_at")) | (F.col("_r") == F.ceil("_at")))
    sides = places.groupBy(*keys, "_f", "_at").agg(F.min_by("_value", "_r").alias("_lo"), F.max_by("_value", "_r").alias("_hi"))
    share = F.col("_at") - F.floor("_at")
    same = (F.col("_lo") == F.col("_hi")) | (share == 0)
    return sides.select(*keys, "_f", F.when(same, F.col("_lo")).otherwise((1 - share) * F.col("_lo") + share * F.col("_hi")).alias("_value"))


def _read_off(numbers: DataFrame, ready: DataFrame, keys: list[str], inner: Column) -> DataFrame:
    """Values of the ranks whose brackets hold few rows, from the counts of the distinct values inside."""
    spans = [*keys, "_low", "_high", "_below"]
    counts = _matched(numbers, ready.select(*spans).distinct(), keys).filter(inner).groupBy(*spans, "_v").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*spans).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    steps = counts.withColumn("_past", upto + F.col("_below")).withColumnsRenamed({"_low": "_l", "_high": "_h"}).drop("_below")
    hit = (F.col("_low").eqNullSafe(F.col("_l")) & F.col("_high").eqNullSafe(F.col("_h"))
           & (F.col("_rank") < F.col("_past")) & (F.col("_rank") >= F.col("_past") - F.col("_k")))
    return _matched(steps, ready, keys).filter(hit).select(*keys, "_rank", F.col("_v").alias("_value"))
