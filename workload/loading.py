"""Reading, storing, canonical tables, scoring and streaming."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ledgerlens.operators import kpis as k
from ledgerlens.operators import score as sc
from ledgerlens.operators.filters import feature_columns, select_kind
from ledgerlens.sources import canonical, readers, tables
from ledgerlens.streaming import daily
from workload.common import cte, r, table, view

MAPPING = {"o_orderkey": "transaction_id", "o_custkey": "customer_id", "o_orderdate": "transaction_date", "l_partkey": "offering_id",
           "p_name": "offering_name", "p_brand": "offering_category", "l_quantity": "quantity", "net": "amount", "spent": "cost"}

RAW_SQL = """SELECT o_orderkey, o_custkey, o_orderdate, l_partkey, p_name, p_brand, l_quantity, l_extendedprice * (1 - l_discount) AS net,
1.9 * l_quantity * p_retailprice AS spent FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""
RAW_TABLES = ("lineitem", "orders", "part")


def raw(s, d):
    return canonical.mapped(s.sql(RAW_SQL, **{n: table(s, d, n) for n in RAW_TABLES}), MAPPING)


def csv_roundtrip(s, d):
    """Orders written as CSV and read back with inferred types."""
    path = tables.shared_folder(s, "csv")
    table(s, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.option("header", True).csv(path)
    return readers.read_csv(s, path).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


def json_roundtrip(s, d):
    """Customers written as JSON lines and read back."""
    path = tables.shared_folder(s, "json")
    table(s, d, "customer").write.json(path)
    return readers.read_json(s, path, lines=True)


def json_wrapped(s, d):
    """Order lines nested per order as one array field, unwrapped again."""
    nested = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    return readers.unwrap_records(nested.select("l_orderkey", "lines"))


def stored(s, d):
    """A dataset saved, replaced by a cleaned version and loaded."""
    root = tables.shared_folder(s, "datasets")
    tables.save_dataset(view(s, d, "events_dirty"), root, "s1", "events")
    tables.save_dataset(tables.load_dataset(s, root, "s1", "events").dropna(subset=["value"]).dropDuplicates(), root, "s1", "events")
    return tables.load_dataset(s, root, "s1", "events")


def records(s, d):
    first = [tables.dataset_record(table(s, d, n), n, f"{n}.csv", "2024-01-01 00:00:00") for n in ("orders", "part")]
    newer = tables.dataset_record(table(s, d, "orders").where("o_orderstatus = 'F'"), "orders", "orders.csv", "2024-02-01 00:00:00")
    extra = tables.dataset_record(table(s, d, "nation"), "nation", "nation.csv", "2024-02-01 00:00:00")
    return tables.upsert_records(first[0].unionByName(first[1]), newer.unionByName(extra)).drop("updated_at")


def line_model(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_quantity", F.col("l_extendedprice").alias("label"))
    model = LinearRegression(featuresCol="features", labelCol="label", solver="normal").fit(sc.with_features(df, ["l_quantity"]))
    return df, model


def batch_score(s, d):
    df, model = line_model(s, d)
    return sc.batch_score(model, df, sc.align_features(df, ["l_quantity"])).select("l_orderkey", "l_quantity", F.round("prediction", 3).alias("prediction"))


def score_classes(s, d):
    df = view(s, d, "pred_binary").select("doc_id", F.col("actual").alias("label"), "predicted", F.col("probability").alias("length_share"))
    model = LogisticRegression(maxIter=20).fit(sc.with_features(df, ["predicted", "length_share"]))
    return sc.score_summary(sc.batch_score(model, df, ["predicted", "length_share"]))


def importances(s, d):
    _, model = line_model(s, d)
    return sc.feature_importances(model, ["l_quantity"], s).withColumn("importance", F.round("importance", 3))


def holdout(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_quantity", F.col("l_extendedprice").alias("label"))
    return sc.evaluate_on_dataset(LinearRegression(solver="normal"), df, ["l_quantity"], "label", "l_orderkey")


def stream(s, d):
    base = tables.shared_folder(s, "stream")
    events = daily.event_stream(s, d, table(s, d, "events").schema, "events.parquet")
    daily.run_available(daily.daily_events(events), f"{base}/out", f"{base}/checkpoint")
    return daily.current_metrics(s, f"{base}/out").drop("approx_users")


def tenant_rollup(s, d):
    """Daily metrics of a tenant stored by day, some of the days at a time, and read back."""
    rows = raw(s, d).select("customer_id", "offering_id", "transaction_date", "amount", "cost")
    path = tables.shared_folder(s, "metrics")
    for days in tables.in_slices(rows, canonical.transaction_day(rows)):
        txn = canonical.transactions(days, "acme")
        metrics = k.daily_metrics(txn, ("tenant_id", "transaction_date", "offering_id"))
        canonical.write_daily_metrics(metrics, path, canonical.files_of_days(txn))
    return canonical.read_daily_metrics(s, path).groupBy("metric_date").agg(
        F.count(F.lit(1)).alias("offerings"), F.sum("transaction_count").alias("transactions"), F.round(F.round(F.sum("revenue"), 8), 4).alias("revenue"))


QUERIES = {
    "csv_roundtrip": csv_roundtrip, "json_roundtrip": json_roundtrip, "json_wrapped": json_wrapped,
    "file_info": lambda s, d: readers.file_info(table(s, d, "lineitem")),
    "dataset_store": stored, "dataset_records": records,
    "preview": lambda s, d: tables.preview(table(s, d, "orders"), "o_orderkey", 20),
    "canonical_transactions": lambda s, d: canonical.transactions(raw(s, d), "acme").withColumns(
        {c: F.round(F.round(c, 8), 4) for c in ("unit_price", "total_amount", "cost", "profit")}),
    "canonical_customers": lambda s, d: canonical.customers(raw(s, d), "acme"),
    "canonical_offerings": lambda s, d: canonical.offerings(raw(s, d), "acme"),
    "tenant_rollup": tenant_rollup,
    "select_numeric": lambda s, d: select_kind(table(s, d, "customer"), "numeric"),
    "feature_columns": lambda s, d: table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(
        *feature_columns(table(s, d, "labels").join(table(s, d, "documents"), "doc_id"), "quality")),
    "batch_score": batch_score, "score_summary": score_classes, "feature_importances": importances, "evaluate_holdout": holdout,
    "metrics_daily_stream": stream,
}

RAW = "WITH raw AS (" + RAW_SQL.format(**{n: n for n in RAW_TABLES}) + ")\n"


def key(x: str) -> str:
    return f"sha256('acme:' || {x})"


_HELD = "CAST('0x' || md5(CAST(l_orderkey AS VARCHAR))[1:6] AS BIGINT) % 1000 < 200"
_FIT = "(SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem{})"

ORACLES = {
    "csv_roundtrip": "SELECT CAST(o_orderkey AS INT) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
    "json_roundtrip": "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer",
    "json_wrapped": "SELECT l_linenumber, l_quantity FROM lineitem",
    "file_info": "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count, (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = 'lineitem') AS columns FROM lineitem",
    "dataset_store": cte("events_dirty") + "SELECT DISTINCT * FROM events_dirty WHERE value IS NOT NULL",
    "dataset_records": """SELECT 'orders' AS dataset_id, 'orders.csv' AS filename, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns
FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'part', 'part.csv', count(*), 6, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' FROM part
UNION ALL SELECT 'nation', 'nation.csv', count(*), 3, 'n_nationkey,n_name,n_regionkey' FROM nation""",
    "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20",
    "canonical_transactions": RAW + f"""SELECT 'acme' AS tenant_id, CAST(o_orderkey AS VARCHAR) AS external_id, {key('o_custkey')} AS customer_id, {key('l_partkey')} AS offering_id, CAST(o_orderdate AS DATE) AS transaction_date,
l_quantity AS quantity, {r('net / l_quantity', 4)} AS unit_price, {r('net', 4)} AS total_amount, {r('spent', 4)} AS cost, {r('net - spent', 4)} AS profit FROM raw""",
    "canonical_customers": RAW + f"""SELECT {key('o_custkey')} AS id, 'acme' AS tenant_id, sha256(CAST(o_custkey AS VARCHAR)) AS external_id_hash, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS email_hash,
CAST(min(o_orderdate) AS DATE) AS first_seen, CAST(max(o_orderdate) AS DATE) AS last_seen, count(*) AS total_transactions, {r('sum(net)', 4)} AS total_revenue FROM raw GROUP BY o_custkey""",
    "canonical_offerings": RAW + f"""SELECT {key('l_partkey')} AS id, 'acme' AS tenant_id, CAST(l_partkey AS VARCHAR) AS external_id, min(p_name) AS name, min(p_brand) AS category, {r('avg(spent / l_quantity)', 4)} AS unit_cost
FROM raw GROUP BY l_partkey""",
    "tenant_rollup": RAW + f"SELECT CAST(o_orderdate AS DATE) AS metric_date, count(DISTINCT l_partkey) AS offerings, count(*) AS transactions, {r('sum(net)', 4)} AS revenue FROM raw GROUP BY 1",
    "select_numeric": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "feature_columns": "SELECT doc_id, toxic, n_chars FROM labels JOIN documents USING (doc_id)",
    "batch_score": f"SELECT l_orderkey, l_quantity, round(CAST(a + b * l_quantity AS DECIMAL(38,9)), 3)::DOUBLE AS prediction FROM lineitem, {_FIT.format('')}",
    "feature_importances": f"SELECT 'l_quantity' AS feature, round(CAST(abs(b) AS DECIMAL(38,9)), 3)::DOUBLE AS importance FROM {_FIT.format('')}",
    "evaluate_holdout": f"WITH v AS (SELECT l_extendedprice AS y, l_extendedprice - a - b * l_quantity AS e FROM lineitem, {_FIT.format(f' WHERE NOT ({_HELD})')} WHERE {_HELD}) SELECT count(*) AS n_samples, "
    + ", ".join(f"{r(x, 4 if n != 'mape' else 2)} AS {n}" for n, x in {
        "r2_score": "1 - sum(e * e) / (var_pop(y) * count(*))", "adjusted_r2": "1 - (sum(e * e) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 2)",
        "explained_variance": "1 - var_pop(e) / var_pop(y)", "mse": "sum(e * e) / count(*)", "rmse": "sqrt(sum(e * e) / count(*))", "mae": "sum(abs(e)) / count(*)",
        "max_error": "max(abs(e))", "mape": "avg(abs(e / y)) * 100", "median_ae": "median(abs(e))"}.items()) + " FROM v",
    "metrics_daily_stream": f"SELECT CAST(ts AS DATE) AS metric_date, event_type, count(*) AS event_count, {r('sum(value)', 4)} AS total_value FROM events GROUP BY 1, 2",
}
