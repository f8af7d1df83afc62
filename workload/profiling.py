"""Profiling and quality queries."""

from __future__ import annotations

from itertools import combinations

from ledgerlens.operators import profile as p
from workload.charts import _AUTO, _with_edges, histogram_sql
from workload.common import cte, div, r, table, view


def dirty(s, d):
    return view(s, d, "events_dirty")


def seeded(s, d):
    return view(s, d, "events_seeded")


def lineitem(s, d):
    return table(s, d, "lineitem")


# ordinal, name, type, kind, profiler type, loader type
DIRTY_COLUMNS = (
    (0, "event_id", "bigint", "numeric", "identifier", "identifier"),
    (1, "ts", "timestamp_ntz", "temporal", "datetime", "datetime"),
    (2, "user_id", "bigint", "numeric", "identifier", "identifier"),
    (3, "event_type", "string", "string", "category", "category"),
    (4, "value", "double", "numeric", "numeric", "numeric"),
)
DIRTY_NUMBERS = ("event_id", "user_id", "value")
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")

QUERIES = {
    "column_catalog": lambda s, d: p.column_catalog(dirty(s, d)),
    "missing": lambda s, d: p.missing(dirty(s, d)),
    "missing_pattern": lambda s, d: p.missing_patterns(seeded(s, d), "event_id"),
    "numeric_stats": lambda s, d: p.numeric_stats(dirty(s, d)),
    "shape_biased": lambda s, d: p.shape(dirty(s, d)),
    "shape_adjusted": lambda s, d: p.shape_adjusted(dirty(s, d)),
    "normality_k2": lambda s, d: p.normality(dirty(s, d)),
    "iqr_outliers": lambda s, d: p.iqr_outliers(dirty(s, d)),
    "outlier_values": lambda s, d: p.outlier_values(dirty(s, d), "value"),
    "skew_issues": lambda s, d: p.skew_issues(lineitem(s, d).withColumn("l_cubed_price", lineitem_cube())),
    "top_values": lambda s, d: p.top_values(dirty(s, d)),
    "samples": lambda s, d: p.samples(seeded(s, d), "event_id"),
    "semantic_types": lambda s, d: p.semantic_types(dirty(s, d)),
    "correlations": lambda s, d: p.correlations(view(s, d, "txn")),
    "corr_matrix": lambda s, d: p.correlation_matrix(lineitem(s, d)),
    "corr_matrix_gaps": lambda s, d: p.correlation_matrix(dirty(s, d)),
    "strong_correlations": lambda s, d: p.strong_correlations(view(s, d, "txn")),
    "duplicates": lambda s, d: p.duplicates(dirty(s, d)),
    "quality_score": lambda s, d: p.quality_score(dirty(s, d)),
    "issues": lambda s, d: p.issues(dirty(s, d)).drop("fixes"),
    "suggestions": lambda s, d: p.suggestions(dirty(s, d)),
    "distribution": lambda s, d: p.distribution(dirty(s, d), "value"),
    "distribution_histogram": lambda s, d: p.distribution_histogram(lineitem(s, d), "l_extendedprice"),
    "overview": lambda s, d: p.overview(dirty(s, d)),
    "feature_table": lambda s, d: p.feature_table(lineitem(s, d)),
    "ml_readiness": lambda s, d: p.ml_readiness(dirty(s, d)),
    "data_insights": lambda s, d: p.data_insights(dirty(s, d).selectExpr("*", "if(user_id % 3 = 0, null, value) as price")),
    "describe": lambda s, d: p.describe(lineitem(s, d)),
    "distinct_per_column": lambda s, d: p.distinct_per_column(lineitem(s, d)),
    "profile": lambda s, d: p.profile(dirty(s, d)),
}


def lineitem_cube():
    from pyspark.sql import functions as F
    return F.pow("l_extendedprice", F.lit(3))


def each(columns, body: str) -> str:
    return "\nUNION ALL ".join(body.replace("$c", c) for c in columns)


def g1(c: str) -> str:
    """Biased skewness from DuckDB's adjusted one."""
    n = f"CAST(count({c}) AS DOUBLE)"
    return f"(skewness({c}) * ({n} - 2) / sqrt({n} * ({n} - 1)))"


def k2(c: str) -> str:
    n = f"CAST(count({c}) AS DOUBLE)"
    y = f"({g1(c)} * sqrt(({n} + 1) * ({n} + 3) / (6 * ({n} - 2))))"
    b = f"(3 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w = f"(sqrt(2 * ({b} - 1)) - 1)"
    z1 = f"(asinh({y} / sqrt(2 / ({w} - 1))) / sqrt(0.5 * ln({w})))"
    e = f"(3 * ({n} - 1) / ({n} + 1))"
    v = f"(24 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    x = f"((kurtosis_pop({c}) + 3 - {e}) / sqrt({v}))"
    m = f"(6 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * sqrt(6 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))"
    a = f"(6 + 8 / {m} * (2 / {m} + sqrt(1 + 4 / ({m} * {m}))))"
    z2 = f"((1 - 2 / (9 * {a}) - cbrt((1 - 2 / {a}) / (1 + {x} * sqrt(2 / ({a} - 4))))) / sqrt(2 / (9 * {a})))"
    return f"({z1} * {z1} + {z2} * {z2})"


def shape_words(s: str, k: str) -> str:
    return f"""CASE WHEN abs({s}) < 0.5 THEN '{p.SYMMETRIC}' WHEN {s} > 0 THEN '{p.RIGHT_SKEWED}' ELSE '{p.LEFT_SKEWED}' END || '; ' ||
CASE WHEN {k} > 1 THEN '{p.HEAVY_TAILED}' WHEN {k} < -1 THEN '{p.LIGHT_TAILED}' ELSE '{p.NORMAL_TAILED}' END"""


def mode_of(c: str, tab: str) -> str:
    return f"(SELECT {c} FROM {tab} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


Q1, Q3 = "quantile_cont($c, 0.25)", "quantile_cont($c, 0.75)"
LO, HI = f"({Q1} - 1.5 * ({Q3} - {Q1}))", f"({Q3} + 1.5 * ({Q3} - {Q1}))"
OUT = f"(SELECT count(*) FROM events_dirty, (SELECT {LO} AS lo, {HI} AS hi FROM events_dirty) WHERE $c < lo OR $c > hi)"
GAP = "(CAST(count(*) - count($c) AS DOUBLE) / count(*) * 100)"
SEVERITY = f"CASE WHEN {GAP} > 30 THEN 'critical' WHEN {GAP} > 10 THEN 'warning' WHEN {GAP} > 0 THEN 'info' ELSE 'ok' END"
OUT_PCT = f"(CAST({OUT} AS DOUBLE) / count($c) * 100)"

_NAMES = tuple(c[1] for c in DIRTY_COLUMNS)


def _catalog() -> str:
    parts = []
    for i, name, dtype, kind, _, loader in DIRTY_COLUMNS:
        nums = [f"min({name})", f"max({name})", f"avg({name})", f"median({name})", f"stddev_samp({name})", f"sum({name})"]
        cells = [r(x, 4) if kind == "numeric" else "CAST(NULL AS DOUBLE)" for x in nums]
        parts.append(f"SELECT CAST({i} AS INT) AS ordinal, '{name}' AS name, '{dtype}' AS dtype, count(*) - count({name}) AS null_count, "
                     f"count(DISTINCT {name}) AS unique_count, '{loader}' AS semantic_type, {cells[0]} AS min, {cells[1]} AS max, "
                     f"{cells[2]} AS mean, {cells[3]} AS median, {cells[4]} AS std, {cells[5]} AS sum FROM events_dirty")
    return "\nUNION ALL ".join(parts)


def _profile() -> str:
    parts = []
    for i, name, dtype, kind, semantic, _ in DIRTY_COLUMNS:
        num = kind == "numeric"
        stat = {k: (r(x, 4) if num else "CAST(NULL AS DOUBLE)") for k, x in (
            ("mean", "avg($c)"), ("median", "median($c)"), ("std", "stddev_samp($c)"), ("min", "min($c)"), ("max", "max($c)"),
            ("q1", Q1), ("q3", Q3), ("sum", "sum($c)"), ("variance", "var_samp($c)"), ("skewness", g1("$c")),
            ("kurtosis", "kurtosis_pop($c)"), ("normal_p_value", f"exp(-{k2('$c')} / 2)"), ("lower_bound", LO), ("upper_bound", HI))}
        cells = ", ".join(f"{v} AS {k}" for k, v in stat.items())
        parts.append((
            f"SELECT CAST({i} AS INT) AS ordinal, '$c' AS \"column\", '{dtype}' AS dtype, '{semantic}' AS semantic, count(*) - count($c) AS missing, "
            f"{r(GAP, 2)} AS missing_pct, {SEVERITY} AS missing_severity, count(DISTINCT $c) AS \"unique\", "
            f"{r(div('count(DISTINCT $c)', 'count(*)') + ' * 100', 2)} AS unique_pct, {cells}, "
            f"{shape_words(g1('$c'), 'kurtosis_pop($c)') if num else 'NULL'} AS interpretation, "
            f"{OUT if num else 'CAST(NULL AS BIGINT)'} AS outliers, {'CAST(NULL AS BOOLEAN)' if num else 'count(DISTINCT $c) > count(*) * 0.5'} AS is_high_cardinality, "
            f"CAST({mode_of('$c', 'events_dirty')} AS VARCHAR) AS mode FROM events_dirty").replace("$c", name))
    return "\nUNION ALL ".join(parts)


_RUNS = """SELECT '$c' AS "column", CAST(coalesce(max(run), 0) AS BIGINT) AS longest_run,
CASE WHEN (SELECT count($c) FROM events_seeded) = (SELECT count(*) FROM events_seeded) THEN 'none'
WHEN (SELECT count($c) FROM events_seeded) = 0 THEN 'all_missing'
WHEN max(run) > (SELECT count(*) FROM events_seeded) * 0.1 THEN 'systematic_blocks' ELSE 'random' END AS pattern
FROM (SELECT count(*) AS run FROM (SELECT row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY $c IS NULL ORDER BY event_id) AS g, $c IS NULL AS gap
FROM events_seeded) WHERE gap GROUP BY g)"""

_CORR = "SELECT {i} AS a, {j} AS b, '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS r FROM lineitem"
CORRS = "WITH k AS (" + "\nUNION ALL ".join(
    _CORR.format(i=i, j=j, x=LINE_NUMBERS[i], y=LINE_NUMBERS[j]) for i, j in combinations(range(len(LINE_NUMBERS)), 2)) + ")\n"

TXN_NUMBERS = ("customer_id", "offering_id", "quantity", "unit_price", "total_amount", "cost", "profit")
TXN_CORRS = cte("txn") + ", k AS (" + "\nUNION ALL ".join(
    _CORR.format(i=i, j=j, x=TXN_NUMBERS[i], y=TXN_NUMBERS[j]).replace("FROM lineitem", "FROM txn")
    for i, j in combinations(range(len(TXN_NUMBERS)), 2)) + ")\n"

_ISSUES = (
    each(_NAMES, f"""SELECT '$c' AS "column", 'Missing Values' AS issue_type, {SEVERITY} AS severity,
printf('%.1f', {r(GAP, 1)}) || '% missing values (' || (count(*) - count($c)) || ' rows)' AS description FROM events_dirty HAVING count(*) > count($c)""")
    + "\nUNION ALL " + each(DIRTY_NUMBERS, f"""SELECT '$c', 'Outliers', CASE WHEN {OUT_PCT} > 5 THEN 'warning' ELSE 'info' END,
{OUT} || ' outliers detected (' || printf('%.1f', {r(OUT_PCT, 1)}) || '%)' FROM events_dirty HAVING {OUT} > 0""")
    + "\nUNION ALL " + each(DIRTY_NUMBERS, f"""SELECT '$c', 'Skewed Distribution', CASE WHEN abs({g1('$c')}) > 3 THEN 'warning' ELSE 'info' END,
'Highly ' || CASE WHEN {g1('$c')} > 0 THEN 'Right (Positive)' ELSE 'Left (Negative)' END || ' skewed (skew=' || printf('%.4f', {r(g1('$c'), 4)}) || ').'
FROM events_dirty HAVING abs({r(g1('$c'), 4)}) > 1""")
)
_ORDINAL = "CASE \"column\" " + " ".join(f"WHEN '{c[1]}' THEN {c[0]}" for c in DIRTY_COLUMNS) + " END"
_DUPS = "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_dirty)) FROM events_dirty)"
_CELLS = "(count(*) * 5)"
_NULLS = "(count(*) * 5 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value))"
_ALL_OUT = "(" + " + ".join(OUT.replace("$c", c) for c in DIRTY_NUMBERS) + ")"


def _options(issue: str, kind: str) -> str:
    return ", ".join(p.FIX_OPTIONS[issue, kind])


_QUALITY = f"""SELECT (1 - CAST({_NULLS} AS DOUBLE) / {_CELLS}) * 100 AS c,
(CAST(count(DISTINCT event_id) AS DOUBLE) / count(*) * 100 + CAST(count(DISTINCT user_id) AS DOUBLE) / count(*) * 100) / 2 AS u,
greatest(0, 100 - CAST({_ALL_OUT} AS DOUBLE) / {_CELLS} * 100 * 10) AS o, greatest(0, 100 - CAST({_DUPS} AS DOUBLE) / count(*) * 100 * 2) AS d FROM events_dirty"""

ORACLES = {
    "column_catalog": cte("events_dirty") + _catalog(),
    "missing": cte("events_dirty") + each(_NAMES, f"""SELECT '$c' AS "column", count(*) - count($c) AS missing, {r(GAP, 2)} AS percentage, {SEVERITY} AS severity FROM events_dirty"""),
    "missing_pattern": cte("events_seeded") + each(("ts", "user_id", "event_type", "value"), _RUNS),
    "numeric_stats": cte("events_dirty") + each(DIRTY_NUMBERS, f"""SELECT '$c' AS "column", {r('avg($c)', 4)} AS mean, {r('median($c)', 4)} AS median,
{r(mode_of('$c', 'events_dirty'), 4)} AS mode, {r('stddev_samp($c)', 4)} AS std, {r('min($c)', 4)} AS min, {r('max($c)', 4)} AS max, {r(Q1, 4)} AS q1, {r(Q3, 4)} AS q3,
{r('sum($c)', 4)} AS sum, {r('var_samp($c)', 4)} AS variance FROM events_dirty"""),
    "shape_biased": cte("events_dirty") + each(DIRTY_NUMBERS, f"""SELECT '$c' AS "column", {r(g1('$c'), 4)} AS skewness, {r('kurtosis_pop($c)', 4)} AS kurtosis,
{shape_words(g1('$c'), 'kurtosis_pop($c)')} AS interpretation FROM events_dirty"""),
    "shape_adjusted": cte("events_dirty") + each(DIRTY_NUMBERS, f"""SELECT '$c' AS "column", {r('skewness($c)', 4)} AS skewness, {r('kurtosis($c)', 4)} AS kurtosis,
CASE WHEN abs(skewness($c)) < 0.5 THEN '{p.SYMMETRIC}' WHEN skewness($c) > 0 THEN '{p.POSITIVE_SKEW}' ELSE '{p.NEGATIVE_SKEW}' END AS skew_interpretation FROM events_dirty"""),
    "normality_k2": cte("events_dirty") + each(DIRTY_NUMBERS, f"""SELECT '$c' AS "column", {r(k2('$c'), 4)} AS statistic, {r(f"exp(-{k2('$c')} / 2)", 4)} AS p_value,
exp(-{k2('$c')} / 2) > 0.05 AS is_normal FROM events_dirty"""),
    "iqr_outliers": cte("events_dirty") + each(DIRTY_NUMBERS, f"""SELECT '$c' AS "column", {OUT} AS count, {r(OUT_PCT, 2)} AS percentage, {r(LO, 4)} AS lower_bound, {r(HI, 4)} AS upper_bound,
CASE WHEN {OUT_PCT} > 5 THEN 'warning' WHEN {OUT} > 0 THEN 'info' ELSE 'ok' END AS severity FROM events_dirty"""),
    "outlier_values": cte("events_dirty") + f"""SELECT {r('value', 4)} AS value FROM events_dirty, (SELECT {LO.replace('$c', 'value')} AS lo, {HI.replace('$c', 'value')} AS hi FROM events_dirty)
WHERE value < lo OR value > hi""",
    "skew_issues": "WITH l AS (SELECT *, pow(l_extendedprice, 3) AS l_cubed_price FROM lineitem)\n" + each((*LINE_NUMBERS, "l_cubed_price"), f"""SELECT '$c' AS "column", {r(g1('$c'), 4)} AS skewness,
CASE WHEN {g1('$c')} > 0 THEN 'Right (Positive)' ELSE 'Left (Negative)' END AS direction, CASE WHEN abs({r(g1('$c'), 4)}) > 3 THEN 'warning' ELSE 'info' END AS severity
FROM l HAVING abs({r(g1('$c'), 4)}) > 1"""),
    "top_values": cte("events_dirty") + each(("ts", "event_type"), f"""SELECT '$c' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, CAST($c AS VARCHAR)) AS INT) AS rank, CAST($c AS VARCHAR) AS value,
count(*) AS count, {r(div('count(*)', '(SELECT count(*) FROM events_dirty)') + ' * 100', 2)} AS percentage,
(SELECT count(DISTINCT $c) > count(*) * 0.5 FROM events_dirty) AS is_high_cardinality FROM events_dirty WHERE $c IS NOT NULL GROUP BY $c QUALIFY rank <= 10"""),
    "samples": cte("events_seeded") + "\nUNION ALL ".join(f"""SELECT CAST({c[0]} AS INT) AS ordinal, CAST(row_number() OVER (ORDER BY event_id) - 1 AS INT) AS position, CAST({c[1]} AS VARCHAR) AS value
FROM events_seeded WHERE {c[1]} IS NOT NULL QUALIFY position < 5""" for c in DIRTY_COLUMNS),
    "correlations": TXN_CORRS + f"""SELECT x AS column1, y AS column2, {r('r', 4)} AS correlation,
CASE WHEN abs(r) > 0.8 THEN 'very strong ' WHEN abs(r) > 0.6 THEN 'strong ' WHEN abs(r) > 0.4 THEN 'moderate ' ELSE 'weak ' END || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS strength
FROM k WHERE abs(r) > 0.3""",
    "corr_matrix": CORRS + f"SELECT x, y, {r('r', 4)} AS value FROM k UNION ALL SELECT y, x, {r('r', 4)} FROM k UNION ALL " + each(LINE_NUMBERS, "SELECT '$c', '$c', CAST(1.0 AS DOUBLE)"),
    "corr_matrix_gaps": cte("events_dirty") + "\nUNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {r('max(1.0)' if x == y else f'corr({x}, {y})', 4)} AS value FROM events_dirty"
        for x in DIRTY_NUMBERS for y in DIRTY_NUMBERS),
    "strong_correlations": TXN_CORRS + f"""SELECT x AS var1, y AS var2, {r('r', 4)} AS correlation, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength
FROM k WHERE abs(r) > 0.5 ORDER BY abs(r) DESC LIMIT 10""",
    "semantic_types": cte("events_dirty") + "\nUNION ALL ".join(
        f"SELECT CAST({c[0]} AS INT) AS ordinal, '{c[1]}' AS \"column\", '{c[4]}' AS profile_type, '{c[5]}' AS loader_type" for c in DIRTY_COLUMNS),
    "duplicates": cte("events_dirty") + f"SELECT {_DUPS} AS count, {r(f'CAST({_DUPS} AS DOUBLE) / count(*) * 100', 2)} AS percentage FROM events_dirty",
    "quality_score": cte("events_dirty") + f"""SELECT {r('c', 4)} AS completeness, {r('u', 4)} AS uniqueness, {r('o', 4)} AS outlier_score, {r('d', 4)} AS duplicate_score,
{r('c * 0.4 + u * 0.2 + o * 0.2 + d * 0.2', 1)} AS quality_score FROM ({_QUALITY})""",
    "issues": cte("events_dirty") + f"SELECT CAST({_ORDINAL} AS INT) AS ordinal, * FROM ({_ISSUES})",
    "suggestions": cte("events_dirty") + f"""SELECT CAST(CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS INT) AS priority, "column", issue_type, description,
CASE issue_type WHEN 'Missing Values' THEN 'drop' WHEN 'Outliers' THEN 'remove' ELSE 'log_transform' END AS recommended,
CASE WHEN issue_type = 'Missing Values' AND "column" IN ('event_id', 'user_id', 'value') THEN '{_options('Missing Values', 'numeric')}'
WHEN issue_type = 'Missing Values' THEN '{_options('Missing Values', 'other')}' WHEN issue_type = 'Outliers' THEN '{_options('Outliers', 'any')}'
ELSE '{_options('Skewed Distribution', 'any')}' END AS options FROM ({_ISSUES})
UNION ALL SELECT 2::INT, 'all', 'duplicates', {_DUPS} || ' duplicate rows found', 'drop_duplicates', '{_options('duplicates', 'any')}'""",
    "distribution": cte("events_dirty") + (f"""SELECT count($c) AS count, count(*) - count($c) AS missing, {r(GAP, 2)} AS missing_pct, {r('avg($c)', 4)} AS mean, {r('stddev_samp($c)', 4)} AS std,
{r('var_samp($c)', 4)} AS variance, {r('min($c)', 4)} AS min, {r('max($c)', 4)} AS max, {r(mode_of('$c', 'events_dirty'), 4)} AS mode, {r('max($c) - min($c)', 4)} AS range, """
        + ", ".join(f"{r(f'quantile_cont($c, {q / 100})', 4)} AS p{q}" for q in p.PERCENTILES)
        + f""", {r(f'{Q3} - {Q1}', 4)} AS iqr, {r('skewness($c)', 4)} AS skewness, {r('kurtosis($c)', 4)} AS kurtosis, {OUT} AS outliers, {r(OUT_PCT, 2)} AS outlier_pct,
{r(LO, 4)} AS lower_bound, {r(HI, 4)} AS upper_bound, {r(f"exp(-{k2('$c')} / 2)", 4)} AS normal_p_value FROM events_dirty""").replace("$c", "value"),
    "distribution_histogram": _with_edges("l_extendedprice", "lineitem", _AUTO) + histogram_sql("lineitem"),
    "overview": cte("events_dirty") + f"""SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS numeric_columns, CAST(1 AS BIGINT) AS categorical_columns,
CAST(1 AS BIGINT) AS datetime_columns, {r(f'CAST({_NULLS} AS DOUBLE) / {_CELLS} * 100', 2)} AS missing_pct, {_DUPS} AS duplicate_rows FROM events_dirty""",
    "feature_table": "\nUNION ALL ".join(f"""SELECT '{c}' AS feature, '{'int' if c == 'l_linenumber' else 'bigint' if c.endswith('key') else 'double'}' AS dtype,
{r(f'CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100', 2)} AS missing_pct, count(DISTINCT {c}) AS "unique", {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std FROM lineitem""" for c in LINE_NUMBERS),
    "ml_readiness": cte("events_dirty") + f"""SELECT {r(f"greatest(0, 100 - least(20, g) - 5 * w - CASE WHEN d > 5 THEN 10 ELSE 0 END)", 1)} AS score, {r('g', 2)} AS missing_pct,
CAST(w AS BIGINT) AS high_cardinality_columns, {r('d', 2)} AS duplicate_pct, true AS has_target
FROM (SELECT CAST({_NULLS} AS DOUBLE) / {_CELLS} * 100 AS g, CASE WHEN count(DISTINCT event_type) > count(*) * 0.5 THEN 1 ELSE 0 END AS w, CAST({_DUPS} AS DOUBLE) / count(*) * 100 AS d FROM events_dirty)""",
    "data_insights": cte("events_dirty") + f"""SELECT 'warning' AS type, 'High Missing Values in price' AS title, printf('%.1f', {r(GAP.replace('$c', 'price'), 1)}) || '% missing' AS description, 'price' AS "column"
FROM (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS price FROM events_dirty)""",
    "describe": each(LINE_NUMBERS, f"""SELECT '$c' AS "column", count($c) AS count, {r('avg($c)', 4)} AS mean, {r('stddev_samp($c)', 4)} AS std, {r('min($c)', 4)} AS min,
{r(Q1, 4)} AS q1, {r('median($c)', 4)} AS median, {r(Q3, 4)} AS q3, {r('max($c)', 4)} AS max FROM lineitem"""),
    "distinct_per_column": each((*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"), f"""SELECT '$c' AS "column", count(DISTINCT $c) AS "unique",
{r(div('count(DISTINCT $c)', 'count(*)') + ' * 100', 2)} AS percentage FROM lineitem"""),
    "profile": cte("events_dirty") + _profile(),
}
