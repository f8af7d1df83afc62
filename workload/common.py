"""Tables, derived views and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

START, END = "2000-01-01", "2000-12-31"
PREV_START, PREV_END = "1998-12-31", "1999-12-31"

TXN_SQL = """SELECT o_custkey AS customer_id, l_partkey AS offering_id, CAST(o_orderdate AS DATE) AS transaction_date,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       l_extendedprice * (1 - l_discount) AS total_amount,
       1.9 * l_quantity * p_retailprice AS cost,
       l_extendedprice * (1 - l_discount) - 1.9 * l_quantity * p_retailprice AS profit
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""

OFFERING_SQL = """SELECT p_partkey AS id, p_name AS name, p_brand AS category, lower(p_type) AS offering_type FROM {part}"""

CUSTOMER_SQL = "SELECT c_custkey AS id, c_name AS name FROM {customer}"

EVENTS_SEEDED_SQL = """SELECT event_id, ts, user_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM {events}"""

EVENTS_DIRTY_SQL = "WITH d AS (" + EVENTS_SEEDED_SQL + """)
SELECT * FROM d UNION ALL SELECT * FROM d WHERE event_id % 50 = 0"""

PRED_BINARY_SQL = """SELECT l.doc_id, l.quality AS actual, CAST(n_chars > 200 AS INT) AS predicted,
       CAST(n_chars AS DOUBLE) / (n_chars + 200) AS probability
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""

PRED_MULTI_SQL = """SELECT vec_id, label AS actual,
       CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS predicted,
       CAST(vec_id % 100 AS DOUBLE) / 100 AS iou FROM {embeddings}"""

PRED_REG_SQL = """SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, l_quantity * 1500.0 AS predicted
FROM {lineitem}"""

VIEWS = {
    "txn": TXN_SQL,
    "offering": OFFERING_SQL,
    "buyer": CUSTOMER_SQL,
    "events_seeded": EVENTS_SEEDED_SQL,
    "events_dirty": EVENTS_DIRTY_SQL,
    "pred_binary": PRED_BINARY_SQL,
    "pred_multi": PRED_MULTI_SQL,
    "pred_reg": PRED_REG_SQL,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views, bound to the tables it names."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def view_sql(name: str) -> str:
    """The view as plain SQL over the registered table names."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def cte(*names: str) -> str:
    """``WITH`` clause that defines the named views for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({view_sql(n)})" for n in names) + "\n"


def r(expr: str, digits: int) -> str:
    """Half-up rounding after removing floating noise, as ``rounded`` does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,{digits + 4})), {digits}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"
