"""Classification and schema mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import classify as c
from ledgerlens.operators import mapping as m
from ledgerlens.functions.text import indel_ratio
from ledgerlens.plans import signatures as sig
from ledgerlens.plans.catalog import local_table
from workload.common import TABLES, div, r, table
from workload.linking import COLUMNS, _lcs

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}


def sources(s, d):
    return {n: c.Source(table(s, d, n), KEYS[n], f"{n}.csv") for n in TABLES}


def kinds(s, d):
    return c.content_types(sources(s, d))


def orders_mapping(s, d):
    return m.column_mapping(table(s, d, "orders"))


def changed(s, d):
    given = local_table(s, [("o_totalprice", "amount"), ("o_orderdate", "transaction_date")], "original_column string, canonical_field string")
    return m.override_mappings(orders_mapping(s, d), given)


def name_pairs(s, d):
    """Similarity of every pair of column names of two tables."""
    a = table(s, d, "orders").agg(F.count("*")).select(F.explode(F.array(*[F.lit(x.split(":")[0]) for x in COLUMNS["orders"].split()])).alias("a"))
    return a.select("a", F.explode(F.array(*[F.lit(x.split(":")[0]) for x in COLUMNS["lineitem"].split()])).alias("b")).select(
        "a", "b", F.round(indel_ratio(F.col("a"), F.col("b")), 6).alias("similarity"))


QUERIES = {
    "name_similarity": name_pairs,
    "content_type": kinds,
    "content_type_scores": lambda s, d: c.content_scores(c.dataset_facts(sources(s, d))).select(
        "dataset", "content_type", *[F.round(x, 6).alias(x) for x in ("column_score", "value_score", "pattern_score", "hint_score", "raw_score")]),
    "dataset_role": lambda s, d: c.dataset_roles(sources(s, d)),
    "early_content_type": lambda s, d: c.early_types(c.dataset_facts(sources(s, d), values=False)),
    "time_coverage": lambda s, d: c.time_coverage(sources(s, d)),
    "typed_columns": lambda s, d: c.typed_columns(c.Source(
        table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"), "o_orderstatus"), "o_orderkey")),
    "persona": lambda s, d: c.persona(sources(s, d)),
    "persona_domains": lambda s, d: c.persona_domains(c.dataset_facts(sources(s, d), values=False)),
    "persona_by_content": lambda s, d: c.persona_by_content(sources(s, d)),
    "session_persona": lambda s, d: c.session_persona(kinds(s, d)),
    "type_compatibility": lambda s, d: m.type_scores(table(s, d, "orders")),
    "column_mapping": orders_mapping,
    "mapping_changed": lambda s, d: m.confirm_mappings(changed(s, d), ["o_orderkey"]),
    "mapping_health": lambda s, d: m.mapping_health(changed(s, d), "transactional"),
    "mapping_warnings": lambda s, d: m.mapping_warnings(changed(s, d), "transactional"),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def _names(t: str) -> list[str]:
    extra = {"embeddings": ["vec_id", "embedding", "label"]}
    return extra.get(t) or [x.split(":")[0] for x in COLUMNS[t].split()]


def _kinds(t: str) -> str:
    return COLUMNS[t]


PATTERNS = sorted({p for *_, pats in sig.CONTENT_SIGNATURES for p in pats})


def _facts() -> str:
    parts = []
    for t in TABLES:
        names, specs = _names(t), _kinds(t)
        strings = [x.split(":")[0] for x in specs.split() if x.endswith(":s")]
        wordy = " OR ".join(f"avg(length({x})) > 50" for x in strings) or "false"
        numbers = any(x[-1] in "id" for x in specs.split())
        times = [x.split(":")[0] for x in specs.split() if x.endswith(":t")]
        readable = [x.split(":")[0] for x in specs.split() if x[-1] in "st"]
        line = "concat_ws(' ', " + ", ".join(f"CAST({n} AS VARCHAR)" for n in readable) + ")"
        dated = "true" if times else " OR ".join(
            rf"coalesce(bool_and(regexp_matches({x}, '^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}-\d{{2}}-\d{{4}})')) FILTER ({x} IS NOT NULL), false)"
            for x in strings) or "false"
        found = "list_filter([" + ", ".join(f"CASE WHEN bool_or(regexp_matches({line}, {q('(?i)' + p)})) THEN {q(p)} END" for p in PATTERNS) + "], lambda x: x IS NOT NULL)" \
            if readable else "[]::VARCHAR[]"
        parts.append(f"""SELECT '{t}' AS dataset, '{t}.csv' AS filename, count(*) AS rows, {len(names)} AS cols, {lst(names)} AS names, {q(' '.join(names).replace('_', ' '))} AS plain,
coalesce({wordy}, false) AS wordy, {dated} AS dated, {str(numbers).lower()} AS numbers, {str(any('id' in n for n in names)).lower()} AS ids, {found} AS found FROM {t}""")
    return "WITH f AS (" + "\nUNION ALL ".join(parts) + ")"


FACTS = _facts()
_SIGS = ",\nsigs AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{t}', '{cat}', {lst(req)}, {lst(opt)}, {lst(pats)}, {lst([h for h, x in sig.FILENAME_HINTS if x == t])})"
    for i, (t, cat, req, opt, pats) in enumerate((*sig.CONTENT_SIGNATURES, ("model_weights", "unknown", (), (), ())))
) + ") v(ord, kind, cat, req, opt, pats, hints))"


def hits(items: str, text: str) -> str:
    return f"len(list_filter({items}, lambda x: contains({text}, x)))"


SCORES = FACTS + _SIGS + f""",
sc AS (SELECT f.*, ord, kind, cat, CASE WHEN {hits('req', 'plain')} > 0 THEN {div(hits('req', 'plain'), 'len(req)')} * 0.7 + coalesce({div(hits('opt', 'plain'), 'len(opt)')}, 0) * 0.3 ELSE 0 END AS a,
coalesce({div("len(list_filter(pats, lambda x: list_contains(found, x)))", 'len(pats)')}, 0) AS b,
CASE WHEN kind = 'time_series' AND dated THEN 0.5::DOUBLE WHEN kind IN ('sales_transactions', 'financial_data') AND numbers THEN 0.3 WHEN kind IN ('customers', 'orders') AND ids THEN 0.2 ELSE 0 END AS c,
CAST({hits('hints', 'filename')} AS DOUBLE) * 0.3 AS h FROM f CROSS JOIN sigs),
raw AS (SELECT *, round(a + b + c + h, 9) AS raw FROM sc WHERE cat <> 'unknown' OR h > 0)"""

_ROLE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sig.CONTENT_ROLES.items()) + " ELSE 'reference' END"
_TEXT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in sig.CONTENT_TEXTS.items()) + " ELSE list_aggregate(list_transform(string_split(kind, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' Data' END"


def _entities(table_) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN len(list_filter(names, lambda n: len(list_filter({lst(ws)}, lambda w: contains(n, w))) > 0)) > 0 THEN '{e}' END" for e, ws in table_) + ")"


KIND = SCORES + f""",
rk AS (SELECT *, max(raw) OVER (PARTITION BY dataset) AS top, row_number() OVER (PARTITION BY dataset ORDER BY raw DESC, ord) AS rn FROM raw),
ct AS (SELECT dataset, kind AS content_type, cat AS category, {r('least(raw / top * 100, 99)', 1)} AS confidence, {r('raw', 4)} AS raw_score, {_ROLE} AS role,
{_TEXT} || ' (' || format('{{:,}}', rows) || ' rows, ' || cols || ' columns)' AS description,
coalesce((SELECT string_agg(o.kind, ',' ORDER BY o.rn) FROM rk o WHERE o.dataset = rk.dataset AND o.rn BETWEEN 2 AND 4 AND o.raw / o.top > 0.15), '') AS alternates, {_entities(sig.CONTENT_ENTITIES)} AS entities,
{r('a * 100', 1)} AS column_match, {r('b * 100', 1)} AS value_match, {r('c * 100', 1)} AS pattern_match FROM rk WHERE rn = 1)
"""
_TRAITS = {"has_date": "dated", "no_dates": "NOT dated", "has_amount": "numbers", "small_row_count": "rows < 100", "has_text_content": "wordy"}
ROLES = FACTS + ",\nrs AS (" + "\nUNION ALL ".join(
    f"""SELECT dataset, names, {i} AS ord, '{role}' AS role, round((len(list_filter({lst(pats)}, lambda p: len(list_filter(names, lambda n: regexp_matches(n, p))) > 0)) / {len(pats)}.0::DOUBLE * 0.4
+ len(list_filter({lst(words)}, lambda w: len(list_filter(names, lambda n: contains(n, w))) > 0)) / {len(words)}.0::DOUBLE * 0.3
+ ({' + '.join(f'CASE WHEN {_TRAITS[t]} THEN 1 ELSE 0 END' for t in traits) or '0'}) / {of}.0::DOUBLE * 0.3) * {weight}, 9) AS s FROM f"""
    for i, (role, pats, words, traits, of, weight) in enumerate(sig.ROLE_SIGNALS)) + f""")
SELECT dataset, role, {r('least(s, 0.99)', 2)} AS confidence, {r('least(s, 0.99)', 2)} < 0.8 AS requires_confirmation, {_entities(sig.ROLE_ENTITIES)} AS entities
FROM rs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY s DESC, ord) = 1"""
EARLY = FACTS + ",\nes AS (" + "\nUNION ALL ".join(
    f"""SELECT dataset, {i} AS ord, '{cat}' AS cat, round(len(list_filter({lst(ws)}, lambda w: len(list_filter(names, lambda n: contains(n, w))) > 0)) / {len(ws)}.0::DOUBLE
+ len(list_filter({lst(ws)}, lambda w: list_contains(names, w))) * 0.2::DOUBLE, 9) AS s FROM f""" for i, (cat, ws) in enumerate(sig.EARLY_CATEGORIES)) + """),
eb AS (SELECT *, CAST(least(100, floor(round(s * 100, 6))) AS INT) AS p FROM es QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY s DESC, ord) = 1)
SELECT dataset, CASE WHEN p < 20 THEN 'general' ELSE cat END AS category, p AS confidence FROM eb"""
_TITLE = {"business": "Business/", "analytics": "Analytics/", "ml_engineer": "ML/"}
WORDS = FACTS + ",\npw AS (SELECT dataset, persona, domain, category, list_sum(list_transform(names, lambda n: len(list_filter(words, lambda w: contains(n, w))))) * 0.5::DOUBLE + " + hits("words", "filename") + """ AS s
FROM f CROSS JOIN (VALUES """ + ", ".join(f"('{p}', '{_TITLE[p]}{dm}', '{ct}', {lst(ws)})" for p, dm, ct, ws in sig.PERSONA_WORDS) + ") v(persona, domain, category, words))"


def _decide(points: str, boards: dict) -> str:
    order = ", ".join(f"({i}, '{p}', '{boards[p]}', {q('; '.join(sig.PERSONA_ADVICE[p]))})" for i, p in enumerate(sig.PERSONAS))
    return f""",
ps AS (SELECT coalesce(sum(s) FILTER (persona = 'business'), 0) AS business, coalesce(sum(s) FILTER (persona = 'analytics'), 0) AS analytics,
coalesce(sum(s) FILTER (persona = 'ml_engineer'), 0) AS ml_engineer, coalesce(sum(s) FILTER (persona = 'developer'), 0) AS developer FROM ({points})),
pd AS (SELECT *, CASE WHEN analytics > 0 AND ml_engineer > 0 THEN (analytics + ml_engineer) * 0.8 ELSE 0 END AS data_scientist FROM ps),
pr AS (SELECT pd.*, o.*, CASE p WHEN 'business' THEN business WHEN 'analytics' THEN analytics WHEN 'ml_engineer' THEN ml_engineer WHEN 'developer' THEN developer ELSE data_scientist END AS sc
FROM pd, (VALUES {order}) o(ord, p, board, advice))
SELECT p AS persona, {r('sc / (business + analytics + ml_engineer + developer + data_scientist)', 4)} AS confidence, board AS dashboard_type, advice AS recommended,
{', '.join(f"{r(x, 4)} AS {x}_score" for x in sig.PERSONAS)} FROM pr ORDER BY round(sc, 9) DESC, ord LIMIT 1"""


_CONTENT_POINTS = "\nUNION ALL ".join(
    f"SELECT '{p}' AS persona, confidence / 100 * {w} AS s FROM ct WHERE list_contains({lst(types)}, content_type)" for p, w, types in sig.CONTENT_PERSONAS)

_SHAPE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"


def _types(i: int, col: str, kind: str) -> str:
    v = f"CAST({col} AS VARCHAR)"
    date = "1.0" if kind == "t" else f"avg(CASE WHEN regexp_matches(v, '{_SHAPE}') THEN 1.0::DOUBLE ELSE 0 END)" if kind == "s" else "0.0"
    num = "1.0" if kind in "id" else "avg(CASE WHEN TRY_CAST(regexp_replace(v, '[$,€£]', '', 'g') AS DOUBLE) IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)" if kind == "s" else "0.0"
    text = "CASE WHEN avg(length(v)) > 3 THEN 0.8 ELSE 0.4 END" if kind == "s" else "0.3"
    cells = {"id": "CASE WHEN CAST(count(DISTINCT v) AS DOUBLE) / count(*) > 0.9 THEN 0.8 ELSE 0.5 END", "date": date, "numeric": num,
             "email": r"avg(CASE WHEN regexp_full_match(v, '[\w\.-]+@[\w\.-]+\.\w+') THEN 1.0::DOUBLE ELSE 0 END)", "text": text}
    return f"SELECT CAST({i} AS INT) AS ordinal, '{col}' AS \"column\", " + ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in cells.items()) + \
        f" FROM (SELECT {v} AS v FROM orders WHERE {col} IS NOT NULL)"


TYPES = "\nUNION ALL ".join(_types(i, *x.split(":")) for i, x in enumerate(COLUMNS["orders"].split()))


def _field_scores() -> str:
    """Score of every orders column for every canonical field."""
    parts = []
    for i, x in enumerate(COLUMNS["orders"].split()):
        name = x.split(":")[0]
        for j, (field, variants, kind) in enumerate(sig.CANONICAL_FIELDS):
            best = max(1.0 if name == v else 2 * _lcs(name, v) / (len(name) + len(v)) for v in variants)
            parts.append(f"SELECT {i} AS ordinal, {j} AS position, '{field}' AS field, round({best!r}::DOUBLE * 0.6 + (SELECT {kind} FROM ty WHERE ordinal = {i}) * 0.4, 9) AS score")
    return "\nUNION ALL ".join(parts)


def _greedy() -> str:
    """One CTE per column in order: its best field among those not taken before."""
    out = f"WITH ty AS ({TYPES}),\nfs AS ({_field_scores()})"
    names = [x.split(":")[0] for x in COLUMNS["orders"].split()]
    for i in range(len(names)):
        taken = " UNION ALL ".join(f"SELECT field FROM g{j}" for j in range(i)) or "SELECT NULL WHERE false"
        out += f",\ng{i} AS (SELECT field, score FROM fs WHERE ordinal = {i} AND score > 0.4 AND field NOT IN (SELECT field FROM ({taken}) WHERE field IS NOT NULL) ORDER BY score DESC, position LIMIT 1)"
    out += ",\nmp AS (" + "\nUNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS ordinal, '{n}' AS original_column, (SELECT field FROM g{i}) AS canonical_field, {r(f'(SELECT score FROM g{i})', 2)} AS confidence, false AS confirmed"
        for i, n in enumerate(names)) + ")"
    return out


MAPPED = _greedy()
CHANGED = MAPPED + """,
cg AS (SELECT ordinal, original_column, CASE original_column WHEN 'o_totalprice' THEN 'amount' WHEN 'o_orderdate' THEN 'transaction_date' ELSE canonical_field END AS canonical_field,
CASE WHEN original_column IN ('o_totalprice', 'o_orderdate') THEN 1.0 ELSE confidence END AS confidence, original_column IN ('o_totalprice', 'o_orderdate') AS confirmed FROM mp)
"""
_REQ, _REC = sig.REQUIRED_FIELDS["transactional"], sig.RECOMMENDED_FIELDS["transactional"]


_HAVE = "(SELECT list(DISTINCT canonical_field) FROM cg WHERE canonical_field IS NOT NULL)"


def _missing(fields) -> str:
    return f"list_filter({lst(fields)}, lambda x: NOT list_contains(have, x))"


ORACLES = {
    "name_similarity": "SELECT * FROM (VALUES " + ", ".join(
        f"('{a}', '{b}', {round(2 * _lcs(a, b) / (len(a) + len(b)), 6)!r}::DOUBLE)"
        for a in (x.split(":")[0] for x in COLUMNS["orders"].split()) for b in (x.split(":")[0] for x in COLUMNS["lineitem"].split())) + ") v(a, b, similarity)",
    "content_type": KIND + "SELECT * FROM ct",
    "content_type_scores": SCORES + "\nSELECT dataset, kind AS content_type, round(a, 6) AS column_score, round(b, 6) AS value_score, round(c, 6) AS pattern_score, round(h, 6) AS hint_score, round(raw, 6) AS raw_score FROM raw",
    "dataset_role": ROLES,
    "early_content_type": EARLY,
    "time_coverage": "SELECT 'orders' AS dataset, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS \"end\", 'o_orderdate' AS \"column\" FROM orders UNION ALL "
    "SELECT 'lineitem', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE), 'l_shipdate' FROM lineitem UNION ALL SELECT 'events', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), 'ts' FROM events",
    "typed_columns": r"""WITH t AS (SELECT strftime(o_orderdate, '%m/%d/%Y') AS day, '$' || format('{:,.2f}', o_totalprice) AS price, o_orderstatus FROM orders),
v AS (SELECT 1 AS ordinal, 'day' AS c, day AS v FROM t UNION ALL SELECT 2, 'price', price FROM t UNION ALL SELECT 3, 'o_orderstatus', o_orderstatus FROM t),
s AS (SELECT ordinal, c, avg(CASE WHEN regexp_matches(v, '^\d{2}/\d{2}/\d{4}$') THEN 1.0 ELSE 0 END) > 0.8 AS is_date,
avg(CASE WHEN TRY_CAST(regexp_replace(v, '[$,]', '', 'g') AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) > 0.8 AS is_numeric FROM v WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT CAST(0 AS INT) AS ordinal, 'o_orderkey' AS "column", false AS is_date, true AS is_numeric UNION ALL
SELECT CAST(ordinal AS INT), c, is_date, is_numeric FROM s WHERE is_date OR is_numeric""",
    "persona": WORDS + _decide("SELECT persona, s FROM pw", sig.PERSONA_DASHBOARDS),
    "persona_domains": WORDS + f"\nSELECT domain, category, {r('sum(s)', 4)} AS score FROM pw WHERE s > 0 GROUP BY 1, 2",
    "persona_by_content": KIND.rstrip() + _decide(_CONTENT_POINTS, sig.CONTENT_DASHBOARDS),
    "session_persona": KIND + "SELECT category, count(*) AS n, CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sig.SESSION_PERSONAS.items())
    + " ELSE 'general' END AS persona FROM ct GROUP BY 1 ORDER BY n DESC, min(dataset) LIMIT 1",
    "type_compatibility": TYPES,
    "column_mapping": MAPPED + "\nSELECT * FROM mp",
    "mapping_changed": CHANGED + "SELECT * REPLACE (confirmed OR original_column = 'o_orderkey' AS confirmed) FROM cg",
    "mapping_health": CHANGED + f"""SELECT {r(f"greatest(0, least(1, {div('len(have)', 'n')} - len({_missing(_REQ)}) * 0.2::DOUBLE - len({_missing(_REC)}) * 0.05::DOUBLE))", 2)} AS score,
list_aggregate({_missing(_REQ)}, 'string_agg', ',') AS missing_required_raw, list_aggregate({_missing(_REC)}, 'string_agg', ',') AS missing_recommended_raw, open AS unmapped
FROM (SELECT {_HAVE} AS have, count(*) AS n, count(*) - count(canonical_field) AS open FROM cg)""",
    "mapping_warnings": CHANGED + "\nUNION ALL ".join(
        [f"SELECT 'missing_{f}' AS type, {q(sig.FIELD_WARNINGS.get(f, chr(39) + f + chr(39) + ' is not mapped.') if f in _REC else f'Required field {chr(39)}{f}{chr(39)} is not mapped.')} AS message, '{'warning' if f in _REC else 'error'}' AS severity WHERE '{f}' NOT IN (SELECT canonical_field FROM cg WHERE canonical_field IS NOT NULL)" for f in (*_REQ, *_REC)]
        + ["SELECT 'low_confidence_mappings', count(*) || ' column(s) have low confidence mappings. Please verify.', 'warning' FROM cg WHERE confidence < 0.6 HAVING count(*) > 0",
           "SELECT 'high_unmapped_ratio', (count(*) - count(canonical_field)) || ' columns are not mapped. Some data may not be used.', 'info' FROM cg HAVING count(*) - count(canonical_field) > count(*) * 0.5"]),
}
ORACLES["mapping_health"] = ORACLES["mapping_health"].replace(
    "AS missing_required_raw", "AS missing_required").replace("AS missing_recommended_raw", "AS missing_recommended").replace(
    "list_aggregate(", "coalesce(list_aggregate(").replace("'string_agg', ',') AS", "'string_agg', ','), '') AS")
