"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import clean as c
from ledgerlens.operators import filters as f
from ledgerlens.sources import readers
from workload.common import cte, r, table, view


def dirty(s, d):
    return view(s, d, "events_dirty").select("event_id", "user_id", "event_type", "value")


def seeded(s, d):
    return view(s, d, "events_seeded").select("event_id", "user_id", "event_type", "value")


def tidy(df):
    """Round the repaired column so that both engines agree on its last digits."""
    return df.withColumn("value", F.round(F.round("value", 10), 6))


def gap(method, custom=None):
    return lambda s, d: tidy(c.fill_missing(dirty(s, d), "value", method, custom))


def out(method):
    return lambda s, d: tidy(c.treat_outliers(dirty(s, d), "value", method))


STEPS = [
    c.Cleaning("Missing Values", "value", "fill_median"),
    c.Cleaning("outliers", "value", "cap_iqr"),
    c.Cleaning("Missing Values", "event_type", "fill_unknown"),
    c.Cleaning("duplicates", method="drop_duplicates"),
    c.Cleaning("rename", "value", new_name="amount"),
]

QUERIES = {
    "fill_drop": gap("drop"), "fill_mean": gap("fill_mean"), "fill_median": gap("fill_median"), "fill_zero": gap("fill_zero"),
    "fill_custom": gap("fill_custom", 12.5),
    "fill_mode": lambda s, d: c.fill_missing(dirty(s, d), "event_type", "fill_mode"),
    "fill_unknown": lambda s, d: c.fill_missing(dirty(s, d), "event_type", "fill_unknown"),
    "ffill": lambda s, d: c.fill_missing(seeded(s, d), "event_type", "ffill", order_by="event_id"),
    # text keys with one long prefix, in slices of 2,000 rows
    "ffill_text_key": lambda s, d: c.fill_previous(seeded(s, d).select(
        F.concat(F.lit("https://events.example/items/"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("url"), "event_type"), "event_type", "url", 2000),
    "bfill": lambda s, d: c.fill_missing(seeded(s, d), "event_type", "bfill", order_by="event_id"),
    "interpolate": lambda s, d: tidy(c.fill_missing(seeded(s, d), "value", "interpolate", order_by="event_id")),
    "dedupe_plain": lambda s, d: c.treat_duplicates(dirty(s, d), "drop_duplicates"),
    "dedupe_first": lambda s, d: c.treat_duplicates(dirty(s, d), "keep_first", "event_id", ["user_id", "event_type"]),
    "dedupe_last": lambda s, d: c.treat_duplicates(dirty(s, d), "keep_last", "event_id", ["user_id", "event_type"]),
    "outlier_remove": out("remove"), "cap_iqr": out("cap_iqr"), "cap_pct": out("cap_percentile"),
    "replace_mean": out("replace_mean"), "replace_median": out("replace_median"),
    "log1p": lambda s, d: tidy(c.log_transform(dirty(s, d), "value")),
    "sqrt": lambda s, d: tidy(c.sqrt_transform(dirty(s, d), "value")),
    "custom_formula": lambda s, d: tidy(c.custom_formula(dirty(s, d), "value", "coalesce(value, 0) * 2 + user_id")[0]),
    "convert_float": lambda s, d: f.convert_type(table(s, d, "customer"), "c_name", "float"),
    "convert_int": lambda s, d: f.convert_type(table(s, d, "events").withColumn("raw", F.expr("regexp_extract(props, '([0-9]+)', 1)")), "raw", "int").select("event_id", "raw"),
    "convert_string": lambda s, d: f.convert_type(table(s, d, "customer"), "c_nationkey", "string"),
    "convert_datetime": lambda s, d: f.convert_type(
        table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("raw")), "raw", "datetime"
    ).select("o_orderkey", F.col("raw").cast("date").alias("raw")),
    "rename_drop": lambda s, d: f.drop_column(f.rename_column(table(s, d, "nation"), "n_name", "nation"), "n_regionkey"),
    "default_impute": lambda s, d: tidy(c.default_impute(dirty(s, d))),
    "normalize_columns": lambda s, d: readers.normalize_columns(table(s, d, "region").toDF(" R Region Key ", "R NAME")),
    "clean_apply": lambda s, d: c.apply(dirty(s, d), STEPS, "event_id").withColumn("amount", F.round(F.round("amount", 10), 6)),
    "clean_preview": lambda s, d: c.preview(dirty(s, d), STEPS, "event_id"),
}

E = "event_id, user_id, event_type"
V = "CAST(round(CAST({} AS DECIMAL(38,10)), 6) AS DOUBLE) AS value"
Q = "(SELECT quantile_cont(value, {}) FROM events_dirty)"
A, B = Q.format(0.25), Q.format(0.75)
LO, HI = f"({A} - 1.5 * ({B} - {A}))", f"({B} + 1.5 * ({B} - {A}))"
WITH = cte("events_dirty")
SEED = cte("events_seeded")


def gap_sql(value: str) -> str:
    return WITH + f"SELECT {E}, {V.format(f'coalesce(value, {value})')} FROM events_dirty"


def clip(lo: str, hi: str) -> str:
    return f"CASE WHEN value < {lo} THEN {lo} WHEN value > {hi} THEN {hi} ELSE value END"


def carry(over: str) -> str:
    return SEED + f"""SELECT event_id, user_id, {over} AS event_type, value FROM events_seeded"""


_KEYED = """SELECT event_id, user_id, event_type, value FROM events_dirty
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {}) = 1"""

_S1 = f"s1 AS (SELECT event_id, user_id, event_type, coalesce(value, (SELECT median(value) FROM events_dirty)) AS value FROM events_dirty)"
_A1, _B1 = "(SELECT quantile_cont(value, 0.25) FROM s1)", "(SELECT quantile_cont(value, 0.75) FROM s1)"
_LO1, _HI1 = f"({_A1} - 1.5 * ({_B1} - {_A1}))", f"({_B1} + 1.5 * ({_B1} - {_A1}))"
_STEPS = f""", {_S1},
s2 AS (SELECT event_id, user_id, event_type, {clip(_LO1, _HI1)} AS value FROM s1),
s3 AS (SELECT event_id, user_id, coalesce(event_type, 'Unknown') AS event_type, value FROM s2),
s4 AS (SELECT DISTINCT * FROM s3)
"""


def _state(tag: str, tab: str, col: str | None, numeric: bool) -> str:
    if col is None:
        return ", ".join(f"CAST(NULL AS {'BIGINT' if k in ('nulls', 'unique') else 'DOUBLE'}) AS {tag}_{k}"
                         for k in ("nulls", "unique", "mean", "median", "min", "max"))
    nums = [(k, f"(SELECT {r(f'{fn}({col})', 4)} FROM {tab})" if numeric else "CAST(NULL AS DOUBLE)")
            for k, fn in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))]
    return (f"(SELECT count(*) - count({col}) FROM {tab}) AS {tag}_nulls, (SELECT count(DISTINCT {col}) FROM {tab}) AS {tag}_unique, "
            + ", ".join(f"{v} AS {tag}_{k}" for k, v in nums))


def _step(i, op, col, method, hit, before, after, numeric, after_col="same"):
    after_col = col if after_col == "same" else after_col
    method = f"'{method}'" if method else "NULL"
    column = f"'{col}'" if col else "NULL"
    return (f"SELECT CAST({i} AS INT) AS step, '{op}' AS operation, {column} AS \"column\", {method} AS method, {hit} AS rows_affected, "
            f"(SELECT count(*) FROM {before}) AS rows_before, (SELECT count(*) FROM {after}) AS rows_after, "
            f"{_state('before', before, col, numeric)}, {_state('after', after, after_col, numeric)}")


ORACLES = {
    "fill_drop": WITH + f"SELECT {E}, {V.format('value')} FROM events_dirty WHERE value IS NOT NULL",
    "fill_mean": gap_sql("(SELECT avg(value) FROM events_dirty)"),
    "fill_median": gap_sql("(SELECT median(value) FROM events_dirty)"),
    "fill_zero": gap_sql("0"), "fill_custom": gap_sql("12.5"),
    "fill_mode": WITH + """SELECT event_id, user_id, coalesce(event_type, (SELECT event_type FROM events_dirty WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type, value FROM events_dirty""",
    "fill_unknown": WITH + "SELECT event_id, user_id, coalesce(event_type, 'Unknown') AS event_type, value FROM events_dirty",
    "ffill": carry("last_value(event_type IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "ffill_text_key": SEED + """SELECT 'https://events.example/items/' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS url,
last_value(event_type IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type FROM events_seeded""",
    "bfill": carry("first_value(event_type IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    "interpolate": SEED + f"""SELECT event_id, user_id, event_type, {V.format('CASE WHEN value IS NOT NULL THEN value WHEN b.value IS NULL THEN a.value ELSE a.value + (b.value - a.value) * (n - a.n) / (b.n - a.n) END')}
FROM (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN struct_pack(n := n, value := value) END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
first_value(CASE WHEN value IS NOT NULL THEN struct_pack(n := n, value := value) END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events_seeded))""",
    "dedupe_plain": WITH + f"SELECT DISTINCT {E}, value FROM events_dirty",
    "dedupe_first": WITH + _KEYED.format(""), "dedupe_last": WITH + _KEYED.format("DESC"),
    "outlier_remove": WITH + f"SELECT {E}, {V.format('value')} FROM events_dirty WHERE value IS NULL OR NOT (value < {LO} OR value > {HI})",
    "cap_iqr": WITH + f"SELECT {E}, {V.format(clip(LO, HI))} FROM events_dirty",
    "cap_pct": WITH + f"SELECT {E}, {V.format(clip(Q.format(0.01), Q.format(0.99)))} FROM events_dirty",
    "replace_mean": WITH + f"SELECT {E}, {V.format(f'CASE WHEN value < {LO} OR value > {HI} THEN (SELECT avg(value) FROM events_dirty WHERE value BETWEEN {LO} AND {HI}) ELSE value END')} FROM events_dirty",
    "replace_median": WITH + f"SELECT {E}, {V.format(f'CASE WHEN value < {LO} OR value > {HI} THEN (SELECT median(value) FROM events_dirty WHERE value BETWEEN {LO} AND {HI}) ELSE value END')} FROM events_dirty",
    "log1p": WITH + f"SELECT {E}, {V.format('CASE WHEN value > -1 THEN ln(1 + value) END')} FROM events_dirty",
    "sqrt": WITH + f"SELECT {E}, {V.format('CASE WHEN value >= 0 THEN sqrt(value) END')} FROM events_dirty",
    "custom_formula": WITH + f"SELECT {E}, {V.format('coalesce(value, 0) * 2 + user_id')} FROM events_dirty",
    "convert_float": "SELECT * REPLACE (TRY_CAST(c_name AS DOUBLE) AS c_name) FROM customer",
    "convert_int": "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS raw FROM events",
    "convert_string": "SELECT * REPLACE (CAST(c_nationkey AS VARCHAR) AS c_nationkey) FROM customer",
    "convert_datetime": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS raw FROM orders",
    "rename_drop": "SELECT n_nationkey, n_name AS nation FROM nation",
    "default_impute": WITH + f"""SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, coalesce(event_type, 'Unknown') AS event_type,
{V.format('coalesce(value, (SELECT median(value) FROM events_dirty))')} FROM events_dirty""",
    "normalize_columns": "SELECT r_regionkey AS r_region_key, r_name FROM region",
    "clean_apply": WITH.rstrip() + _STEPS + f"SELECT {E}, CAST(round(CAST(value AS DECIMAL(38,10)), 6) AS DOUBLE) AS amount FROM s4",
    "clean_preview": WITH.rstrip() + _STEPS + "\nUNION ALL ".join([
        _step(1, "missing_values", "value", "fill_median", "(SELECT count(*) - count(value) FROM events_dirty)", "events_dirty", "s1", True),
        _step(2, "outliers", "value", "cap_iqr", f"(SELECT count(*) FROM s1 WHERE value < {_LO1} OR value > {_HI1})", "s1", "s2", True),
        _step(3, "missing_values", "event_type", "fill_unknown", "(SELECT count(*) - count(event_type) FROM s2)", "s2", "s3", False),
        _step(4, "duplicates", None, "drop_duplicates", "(SELECT count(*) - (SELECT count(*) FROM s4) FROM s3)", "s3", "s4", False),
        _step(5, "rename", "value", None, "(SELECT count(*) FROM s4)", "s4", "s4", True, None),
    ]),
}
