"""Link discovery queries."""

from __future__ import annotations

from ledgerlens.operators import links as l
from workload.common import TABLES, div, r, table

# columns that hold comparable values, per table: name and whether text or whole number, time, or fraction
COLUMNS = {
    "region": "r_regionkey:i r_name:s", "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s", "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i label:i", "pages": "page_id:i url:s html:s", "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i", "conversations": "conv_id:i turn:i role:s text:s",
}


def everything(s, d):
    return {name: table(s, d, name) for name in TABLES}


def links(s, d):
    return l.validate_links(everything(s, d))


QUERIES = {
    "linkable_columns": lambda s, d: l.linkable_columns(everything(s, d)),
    "link_overlap": lambda s, d: links(s, d).drop(*l.PLACES),
    "link_best": lambda s, d: l.best_links(links(s, d)).drop(*l.PLACES),
    "link_health": lambda s, d: l.link_health(links(s, d)),
    "link_warnings": lambda s, d: l.link_warnings(links(s, d), everything(s, d)),
    "link_nodes": lambda s, d: l.link_nodes(everything(s, d)),
    "link_edges": lambda s, d: l.link_edges(links(s, d)),
    "infer_relationships": lambda s, d: l.infer_relationships(everything(s, d)),
    "graph_nodes": lambda s, d: l.graph_nodes(l.infer_relationships(everything(s, d))),
    "graph_edges": lambda s, d: l.graph_edges(l.infer_relationships(everything(s, d))),
    "find_relationships": lambda s, d: l.find_relationships(everything(s, d)),
    "concat_datasets": lambda s, d: l.concat_datasets({n: table(s, d, n) for n in ("documents", "labels", "benchmark")}),
    "values_shared": lambda s, d: l.value_sets(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey"),
    "values_missing": lambda s, d: l.value_sets(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey", "difference"),
}


def _slots():
    out = []
    for p, (name, cols) in enumerate(COLUMNS.items()):
        for spec in cols.split():
            col, kind = spec.split(":")
            out.append((len(out), p, name, col, kind))
    return out


_WORDS = " ".join(
    "WHEN " + " OR ".join(f"contains(plain, '{w}')" for w in words) + f" THEN '{label}'" for label, words in l.LINK_WORDS)
CATALOG = "WITH cat AS (" + "\nUNION ALL ".join(
    f"""SELECT {i} AS slot, {p} AS pos, '{t}' AS ds, '{c}' AS col, '{k}' AS kind, translate('{c}', '_-', '  ') AS plain, count(*) AS n, count(DISTINCT {c}) AS u FROM {t}"""
    for i, p, t, c, k in _slots()) + f"""),
lk AS (SELECT *, CASE {_WORDS} WHEN kind IN ('i', 's') AND {div('u', 'n')} > 0.8 THEN 'id' END AS lt FROM cat),
vals AS (""" + "\nUNION ALL ".join(f"SELECT DISTINCT {i} AS slot, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for i, _, t, c, _ in _slots()) + """)
"""


def _pairs(source: str, match: str) -> str:
    """Shared values of every matching pair of columns."""
    return f""", cand AS (SELECT a.slot AS sa, b.slot AS sb, a.pos AS pa, b.pos AS pb, a.ds AS da, b.ds AS db, a.col AS ca, b.col AS cb, a.n AS na, b.n AS nb, a.u AS ua, b.u AS ub
FROM {source} a JOIN {source} b ON a.pos < b.pos WHERE {match}),
sh AS (SELECT sa, sb, count(*) AS m FROM cand JOIN vals x ON x.slot = sa JOIN vals y ON y.slot = sb AND y.v = x.v GROUP BY 1, 2)
"""


BEST = f"greatest({div('m', 'ua')}, {div('m', 'ub')}) * 100"
LINKS = CATALOG + _pairs("(SELECT * FROM lk WHERE lt IS NOT NULL)", "a.lt = b.lt OR a.lt = 'id' OR b.lt = 'id' OR contains(b.col, a.col) OR contains(a.col, b.col)") + f""",
links AS (SELECT pa, pb, sa, sb, da AS source, db AS target, ca AS source_column, cb AS target_column,
CASE WHEN {BEST} >= 80 THEN 'strong' WHEN {BEST} >= 50 THEN 'moderate' WHEN {BEST} >= 20 THEN 'weak' ELSE 'broken' END AS strength, {r(BEST, 1)} AS overlap, m AS matched_count,
ua AS source_unique, ub AS target_unique, {r(f'least({BEST}, 95)', 1)} AS confidence,
concat_ws('; ', CASE WHEN {BEST} < 50 AND ua > m THEN (ua - m) || ' values from source not found in target' END,
CASE WHEN {div('m', 'ua')} * 100 < 20 AND {div('m', 'ub')} * 100 < 20 THEN 'Very low overlap in both directions - possible data mismatch' END) AS issues FROM cand JOIN sh USING (sa, sb)),
best AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY pa, pb ORDER BY overlap DESC, sa, sb) = 1)
"""


def _lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


_SIMILAR = "sim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {j}, {2 * _lcs(a, b) / (len(a) + len(b))!r}::DOUBLE)" for i, p, _, a, _ in _slots() for j, q, _, b, _ in _slots() if p < q) + ") t(sa, sb, sim))"
_IDS = "((contains(a.col, 'id') AND contains(b.col, 'id')) OR a.col = b.col)"
_OVER = div("m", "least(ua, ub)")
INFER = CATALOG.rstrip() + ",\n" + _SIMILAR + _pairs("cat", f"{_IDS} OR (SELECT sim FROM sim WHERE sim.sa = a.slot AND sim.sb = b.slot) > 0.7") + f""",
rel AS (SELECT pa, pb, sa, sb, da AS source_dataset, ca AS source_column, db AS target_dataset, cb AS target_column,
{r(f"least(sim * 0.4 + {_OVER} * 0.4 + CASE WHEN (contains(ca, 'id') AND contains(cb, 'id')) OR ca = cb THEN 0.2 ELSE 0 END, 0.99)", 2)} AS confidence,
CASE WHEN {div('ua', 'na')} > 0.9 AND {div('ub', 'nb')} > 0.9 THEN 'one_to_one' WHEN {div('ua', 'na')} > 0.9 THEN 'one_to_many' WHEN {div('ub', 'nb')} > 0.9 THEN 'many_to_one' ELSE 'many_to_many' END AS cardinality,
{r(_OVER, 2)} AS overlap_score, {r('sim', 2)} AS name_similarity FROM cand JOIN sh USING (sa, sb) JOIN sim USING (sa, sb) WHERE {_OVER} > 0.3
QUALIFY row_number() OVER (PARTITION BY pa, pb ORDER BY confidence DESC, sa, sb) <= 5)
"""


def _stem_value(name: str) -> str:
    for suffix in l.KEY_SUFFIXES:
        if name.endswith(suffix):
            name = name.replace(suffix, "")
    return name


_STEMS = "st AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{_stem_value(c)}')" for i, _, _, c, _ in _slots()) + ") t(slot, stem)),\ncs AS (SELECT cat.*, stem FROM cat JOIN st USING (slot))"
_KEEP = "source, target, source_column, target_column, strength, overlap, matched_count, source_unique, target_unique, confidence, issues"
_SHARE = "printf('%.1f', overlap) || '% overlap between ' || source_column || ' and ' || target_column"
_NAMES = "(VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") t(ds)"

ORACLES = {
    "linkable_columns": CATALOG + "SELECT ds AS dataset, col AS \"column\", lt AS link_type, u AS \"distinct\", n AS rows FROM lk WHERE lt IS NOT NULL",
    "link_overlap": LINKS + f"SELECT {_KEEP} FROM links",
    "link_best": LINKS + f"SELECT {_KEEP} FROM best",
    "link_health": LINKS + f"""SELECT {r('s', 1)} AS health_score, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'fair' ELSE 'poor' END AS health_status, total_links, strong_links
FROM (SELECT avg(overlap) * 0.7 + {div("count(CASE WHEN strength = 'strong' THEN 1 END)", 'count(*)')} * 30 AS s, count(*) AS total_links, count(CASE WHEN strength = 'strong' THEN 1 END) AS strong_links FROM best)""",
    "link_warnings": LINKS + f"""SELECT CASE strength WHEN 'broken' THEN 'broken_link' ELSE 'weak_link' END AS type, CASE strength WHEN 'broken' THEN 'high' ELSE 'medium' END AS severity,
CASE strength WHEN 'broken' THEN 'Weak connection between datasets: Only ' ELSE 'Limited connection: ' END || {_SHARE} AS message, source || ',' || target AS datasets FROM best WHERE strength IN ('broken', 'weak')
UNION ALL SELECT 'isolated_dataset', 'high', 'Dataset has no connections to other uploaded files', ds FROM {_NAMES} WHERE ds NOT IN (SELECT source FROM best UNION SELECT target FROM best)""",
    "link_nodes": "\nUNION ALL ".join(
        f"SELECT '{t}' AS id, count(*) AS rows, (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}') AS columns FROM {t}" for t in TABLES),
    "link_edges": LINKS + "SELECT source, target, strength, overlap, source_column, target_column FROM best",
    "infer_relationships": INFER + "SELECT * EXCLUDE (pa, pb, sa, sb) FROM rel",
    "graph_nodes": INFER + "SELECT source_dataset AS id, 'unknown' AS role FROM rel UNION SELECT target_dataset, 'unknown' FROM rel",
    "graph_edges": INFER + "SELECT source_dataset AS source, target_dataset AS target, source_column, target_column, cardinality, confidence FROM rel WHERE confidence > 0.5",
    "find_relationships": CATALOG.rstrip() + ",\n" + _STEMS + _pairs("cs", "a.col = b.col OR contains(a.stem, b.stem) OR contains(b.stem, a.stem)")
    + f"SELECT da AS dataset1, ca AS column1, db AS dataset2, cb AS column2, {r(_OVER, 4)} AS overlap, 'potential_join' AS type FROM cand JOIN sh USING (sa, sb) WHERE {_OVER} > 0.3",
    "concat_datasets": "SELECT * FROM documents UNION ALL BY NAME SELECT * FROM labels UNION ALL BY NAME SELECT * FROM benchmark",
    "values_shared": "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "values_missing": "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}
