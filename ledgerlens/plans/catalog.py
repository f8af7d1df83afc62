"""Column catalogs: many statistics of many columns from a shared scan."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.functions.dates import is_temporal, to_timestamp_or_null
from ledgerlens.functions.numbers import is_numeric
from ledgerlens.functions.text import EMAIL_SHAPE, looks_like_date, strip_currency, quoted
from ledgerlens.plans.gram import wide_correlations
from ledgerlens.plans.ranks import Quantile, quantile_exprs

# Longer values are compared by digest, so that keys stay short in a shuffle.
LONG_VALUE = 40
COLUMNS_PER_SCAN = 50


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    dtype: str
    kind: str  # numeric, boolean, temporal, string or nested


def local_table(spark, rows: list, schema: T.StructType | str) -> DataFrame:
    """A small table of metadata that the optimizer knows the size of."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = [pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), struct)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All parts below each other by column name, as a balanced tree so that the plan is resolved few times over."""
    while len(parts) > 1:
        pairs = [parts[i:i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]


def kind_of(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_temporal(dtype):
        return "temporal"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "nested"


def columns_of(df: DataFrame, kind: str | None = None) -> list[ColumnInfo]:
    infos = [
        ColumnInfo(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)
    ]
    return [c for c in infos if kind in (None, c.kind)]


def numeric_names(df: DataFrame) -> list[str]:
    return [c.name for c in columns_of(df, "numeric")]


def text_of(info: ColumnInfo) -> Column:
    col = quoted(info.name)
    return F.to_json(F.struct(col.alias("v"))) if info.kind == "nested" else col.cast("string")


def value_key(info: ColumnInfo) -> Column:
    """Text of a value, or a digest of it when it is long; equal values only share a key."""
    text = text_of(info)
    if info.kind in ("string", "nested"):
        return F.when(F.length(text) > LONG_VALUE, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
    return text


def value_shapes(df: DataFrame, infos: list[ColumnInfo] | None = None) -> DataFrame:
    """One row per column: how its values read, over all rows, from one aggregate per block of columns.

    ordinal, column, kind, values (not null), dated (share with the shape of a date), dates (that also
    reads as one), numbers, emails and width (mean length).  Shares of non-text columns are zero.
    """
    infos = columns_of(df) if infos is None else infos
    parts = []
    for at in range(0, len(infos), COLUMNS_PER_SCAN):
        block = infos[at:at + COLUMNS_PER_SCAN]
        wanted, rows = [], []
        for c in block:
            tag, value = f"_{c.ordinal}", quoted(c.name)
            wanted.append(F.count(value).alias(f"n{tag}"))
            cells = {k: F.lit(0.0) for k in ("dated", "dates", "numbers", "emails", "width")}
            if c.kind == "string":
                text = value.cast("string")
                shaped = looks_like_date(text)
                reads = {
                    "dated": shaped, "dates": shaped & to_timestamp_or_null(text, T.StringType()).isNotNull(),
                    "numbers": strip_currency(text).try_cast("double").isNotNull(), "emails": text.rlike(EMAIL_SHAPE)}
                for k, test in reads.items():
                    wanted.append(F.avg(F.when(text.isNotNull(), F.when(test, 1.0).otherwise(0.0))).alias(k + tag))
                wanted.append(F.avg(F.length(text)).alias("width" + tag))
                cells = {k: F.coalesce(k + tag, F.lit(0.0)) for k in cells}
            rows.append(F.struct(F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("column"), F.lit(c.kind).alias("kind"),
                                 F.col(f"n{tag}").alias("values"), *[v.alias(k) for k, v in cells.items()]))
        parts.append(df.agg(*wanted).select(F.inline(F.array(*rows))))
    return union_all(parts)


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_REAL = ("float", "double")


def _lanes(c: ColumnInfo, readable: bool) -> Column:
    """A value in the lane of its type, so that numbers are grouped as numbers.

    Unless the value must stay readable, times travel as microseconds and long
    text as a digest.
    """
    col = quoted(c.name)
    whole, real, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if c.dtype in _WHOLE:
        whole = col.cast("bigint")
    elif c.dtype in _REAL:
        real = col.cast("double")
    elif c.kind == "temporal" and not readable:
        whole = F.unix_micros(col.cast("timestamp"))
    else:
        text = text_of(c) if readable else value_key(c)
    return F.struct(F.lit(c.ordinal).alias("ordinal"), whole.alias("whole"), real.alias("real"), text.alias("text"))


def frequencies(df: DataFrame, infos: list[ColumnInfo], readable: bool = False) -> DataFrame:
    """(ordinal, whole, real, text, n): how often each non-null value occurs in each column.

    One scan for all columns; equal values are combined before the shuffle.
    """
    return (
        df.select(F.inline(F.array(*[_lanes(c, readable) for c in infos])))
        .where(F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False)))
        .groupBy("ordinal", "whole", "real", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lane_text() -> Column:
    """The value of a frequencies row as text."""
    return F.coalesce(F.col("text"), F.col("whole").cast("string"), F.col("real").cast("string"))


def distinct_counts(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """(ordinal, distinct) ignoring nulls; columns without values have no row."""
    return frequencies(df, infos).groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct"))


def _keyed_lanes(c: ColumnInfo) -> Column:
    """A readable value in its lane; a long text as its first characters and a digest, so that no key is long."""
    lanes = _lanes(c, True)
    text = lanes["text"]
    long = F.length(text) > LONG_VALUE
    return F.struct(
        lanes["ordinal"].alias("ordinal"), lanes["whole"].alias("whole"), lanes["real"].alias("real"),
        F.when(long, F.substring(text, 1, LONG_VALUE)).otherwise(text).alias("text"), F.when(long, F.unhex(F.sha2(text, 256))).alias("digest"))


def leading_values(df: DataFrame, infos: list[ColumnInfo], first: int = 1) -> DataFrame:
    """(ordinal, distinct, rank, value, n): the most frequent values of each column, smaller ones first on ties, as text.

    Values are counted by short keys that sort as they do up to equal first characters.  So a long value
    that belongs to the result shares its first characters with one that leads by keys, and only the rows
    with such characters are counted again beside their whole texts.  Distinct values come from the same table.
    """
    session = df.sparkSession
    counts = df.select(F.inline(F.array(*[_keyed_lanes(c) for c in infos]))).where(
        F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))
    ).groupBy("ordinal", "whole", "real", "text", "digest").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct((-F.col("n")).alias("n"), "whole", "real", "text", "digest")
    if first == 1:
        grouped = counts.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct"), F.array(F.min(key)).alias("top"))
    else:
        # the first keys of each part, then of the column, so that no task sorts a column
        parts = counts.withColumn("part", F.pmod(F.xxhash64("whole", "real", "text", "digest"), F.lit(PARTS_PER_COLUMN)))
        ranked = parts.withColumn("key", key).withColumn("turn", F.row_number().over(Window.partitionBy("ordinal", "part").orderBy("key")))
        sizes = parts.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct"))
        best = ranked.where(F.col("turn") <= first).groupBy("ordinal").agg(F.slice(F.array_sort(F.collect_list("key")), 1, first).alias("top"))
        grouped = sizes.join(best, "ordinal")
    told = grouped.collect()  # a row for each column
    short, long = [], set()
    for row in told:
        for cell in row["top"]:
            if cell["digest"] is not None:
                long.add((row["ordinal"], cell["text"]))
            else:
                short.append((row["ordinal"], row["distinct"], cell["whole"], cell["real"], cell["text"], -cell["n"]))
    keys = "ordinal int, `distinct` bigint, whole bigint, real double, text string, n bigint"
    rows = local_table(session, short, keys)
    if long:
        again = [F.struct(F.lit(c.ordinal).alias("ordinal"), text_of(c).alias("text")) for c in infos if c.ordinal in {o for o, _ in long}]
        heads = local_table(session, sorted(long), "o int, head string")
        found = df.select(F.inline(F.array(*again))).where(F.length("text") > LONG_VALUE).join(
            F.broadcast(heads), (F.col("ordinal") == F.col("o")) & (F.substring("text", 1, LONG_VALUE) == F.col("head")), "left_semi")
        sizes = local_table(session, [(r["ordinal"], r["distinct"]) for r in told], "ordinal int, `distinct` bigint")
        texts = found.groupBy("ordinal", F.sha2("text", 256).alias("digest")).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))
        rows = rows.unionByName(texts.join(F.broadcast(sizes), "ordinal").select(
            "ordinal", "distinct", F.lit(None).cast("bigint").alias("whole"), F.lit(None).cast("double").alias("real"), "text", "n"))
    order = Window.partitionBy("ordinal").orderBy(F.col("n").desc(), "whole", "real", "text")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select(
        "ordinal", "distinct", "rank", F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string")).alias("value"), "n")


#: Parts whose leading keys are found apart before they meet.
PARTS_PER_COLUMN = 64


def modes(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """(ordinal, mode): the most frequent value, the smallest one on ties, as text."""
    return leading_values(df, infos).select("ordinal", F.col("value").alias("mode"))


_MOMENTS = {
    "mean": F.avg, "variance": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum, "skew": F.skewness, "kurt": F.kurtosis,
}
_FRACTIONS = {"q1": 0.25, "median": 0.5, "q3": 0.75}
ALL_FACTS = ("mean", "variance", "min", "max", "sum", "skew", "kurt", "q1", "median", "q3")


def facts(df: DataFrame, infos: list[ColumnInfo] | None = None, want: tuple[str, ...] = ALL_FACTS,
          outliers: bool = False, in_memory: int | None = None) -> DataFrame:
    """One row per column: rows, nulls and, for numbers, the wanted moments and quartiles.

    Columns: ordinal, name, dtype, kind, rows, nulls, the names in ``want``, std
    (with variance), and with ``outliers`` also lower, upper and outliers (values
    beyond 1.5 interquartile ranges).  The table is scanned once per block of
    columns, twice with ``outliers``.
    """
    infos = columns_of(df) if infos is None else infos
    if outliers:
        want = tuple(dict.fromkeys((*want, "q1", "q3")))
    rows = df.count() if set(want) & set(_FRACTIONS) else 0
    blocks = [infos[i:i + COLUMNS_PER_SCAN] for i in range(0, len(infos), COLUMNS_PER_SCAN)]
    parts = [_facts_block(df, block, want, outliers, in_memory, rows) for block in blocks]
    return union_all(parts)


def _facts_block(df: DataFrame, infos: list[ColumnInfo], want: tuple[str, ...], outliers: bool, in_memory: int | None,
                 rows: int) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    quantiles: list[Quantile] = []
    for c in infos:
        col = quoted(c.name)
        aggs.append(F.count(col).alias(f"{c.ordinal}_filled"))
        if c.kind == "numeric":
            value = col.cast("double")
            aggs += [_MOMENTS[k](value).alias(f"{c.ordinal}_{k}") for k in want if k in _MOMENTS]
            quantiles += [Quantile(f"{c.ordinal}_{k}", value, _FRACTIONS[k]) for k in want if k in _FRACTIONS]
    wide = df.agg(*aggs, *quantile_exprs(df, quantiles, in_memory, rows))

    def number(c: ColumnInfo, key: str) -> Column:
        return F.col(f"{c.ordinal}_{key}") if c.kind == "numeric" else F.lit(None).cast("double")

    def fence(c: ColumnInfo, side: int) -> Column:
        iqr = number(c, "q3") - number(c, "q1")
        return number(c, "q3") + 1.5 * iqr if side > 0 else number(c, "q1") - 1.5 * iqr

    def described(c: ColumnInfo) -> Column:
        cells = [number(c, k).cast("double").alias(k) for k in want]
        if "variance" in want:
            cells.append(F.sqrt(number(c, "variance")).alias("std"))
        if outliers:
            cells += [fence(c, -1).alias("lower"), fence(c, 1).alias("upper")]
        return F.struct(
            F.lit(c.ordinal).alias("ordinal"), F.lit(c.name).alias("name"), F.lit(c.dtype).alias("dtype"),
            F.lit(c.kind).alias("kind"), F.col("rows"), (F.col("rows") - F.col(f"{c.ordinal}_filled")).alias("nulls"), *cells,
        )

    table = wide.select(F.inline(F.array(*[described(c) for c in infos])))
    if not outliers:
        return table
    numeric = [c for c in infos if c.kind == "numeric"]
    if not numeric:
        return table.withColumn("outliers", F.lit(None).cast("bigint"))
    bounds = wide.select(
        F.struct(*[fence(c, side).alias(f"{c.ordinal}_{side}") for c in numeric for side in (-1, 1)])
    ).scalar()
    beyond = df.agg(*[
        F.count_if(
            (quoted(c.name).cast("double") < bounds[f"{c.ordinal}_-1"])
            | (quoted(c.name).cast("double") > bounds[f"{c.ordinal}_1"])
        ).alias(f"{c.ordinal}_out")
        for c in numeric
    ])
    counted = beyond.select(F.inline(F.array(*[
        F.struct(F.lit(c.ordinal).alias("ordinal"), F.col(f"{c.ordinal}_out").alias("outliers")) for c in numeric
    ])))
    return table.join(F.broadcast(counted), "ordinal", "left")


def with_distinct(table: DataFrame, df: DataFrame, infos: list[ColumnInfo] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Add the exact distinct count of every column of a facts table; from ``counts`` (ordinal, distinct) if they are known."""
    if counts is None:
        counts = distinct_counts(df, columns_of(df) if infos is None else infos)
    return table.join(F.broadcast(counts), "ordinal", "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0).cast("bigint"))
    )


#: Columns up to which every pair is a few sums of one aggregate.
NARROW = 12


def pairwise_correlations(df: DataFrame, names: list[str], narrow: int | None = None) -> DataFrame:
    """(a, b, x, y, r) for every pair of numeric columns, nulls dropped per pair.

    A first aggregate finds means, ranges and gaps of the columns.  With values
    centred on them, a pair of columns without gaps costs one sum more than the
    per-column sums it shares with every other pair.  ``r`` is NULL where a side
    is constant or holds values that are not finite.  More columns than
    ``narrow`` are correlated by their Gram matrix, with the same results.
    """
    if len(names) > (NARROW if narrow is None else narrow):
        return wide_correlations(df, names)
    cols = [quoted(c).cast("double") for c in names]
    head = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[fn(c).alias(f"{k}{i}") for i, c in enumerate(cols)
          for k, fn in (("n", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))],
    ).first()
    centred = [c - F.lit(float(head[f"m{i}"] or 0.0)) for i, c in enumerate(cols)]
    varies = [head[f"n{i}"] > 0 and head[f"lo{i}"] != head[f"hi{i}"] and math.isfinite(head[f"m{i}"]) for i in range(len(cols))]
    full = [head[f"n{i}"] == head["rows"] for i in range(len(cols))]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return local_table(df.sparkSession, [], "a int, b int, x string, y string, r double")
    aggs: dict[str, Column] = {"n": F.count(F.lit(1)).cast("double")}
    results = []
    for i, j in pairs:
        if not (varies[i] and varies[j]):
            r = F.lit(None).cast("double")
        elif full[i] and full[j]:
            for k in (i, j):
                aggs[f"s{k}"] = F.sum(centred[k])
                aggs[f"q{k}"] = F.sum(centred[k] * centred[k])
            aggs[f"p{i}_{j}"] = F.sum(centred[i] * centred[j])
            r = _r(F.col("n"), F.col(f"p{i}_{j}"), F.col(f"s{i}"), F.col(f"s{j}"), F.col(f"q{i}"), F.col(f"q{j}"))
        else:
            both = cols[i].isNotNull() & cols[j].isNotNull()
            x, y = F.when(both, centred[i]), F.when(both, centred[j])
            tag = f"{i}_{j}"
            aggs |= {
                f"c{tag}": F.count(x).cast("double"), f"p{tag}": F.sum(x * y), f"sx{tag}": F.sum(x), f"sy{tag}": F.sum(y),
                f"qx{tag}": F.sum(x * x), f"qy{tag}": F.sum(y * y),
                f"flat{tag}": (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)),
            }
            r = F.when(~F.col(f"flat{tag}"), _r(*[F.col(f"{k}{tag}") for k in ("c", "p", "sx", "sy", "qx", "qy")]))
        results.append(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.lit(names[i]).alias("x"), F.lit(names[j]).alias("y"), r.alias("r")))
    return df.agg(*[c.alias(k) for k, c in aggs.items()]).select(F.inline(F.array(*results)))


def _r(n: Column, sxy: Column, sx: Column, sy: Column, sxx: Column, syy: Column) -> Column:
    covariance = sxy - F.try_divide(sx * sy, n)
    spread = F.sqrt((sxx - F.try_divide(sx * sx, n)) * (syy - F.try_divide(sy * sy, n)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(covariance, spread)))
