"""Canonical star schema and the step from a mapped table to its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerlens.functions.dates import to_timestamp_or_null
from ledgerlens.functions.numbers import rounded
from ledgerlens.functions.text import hashed, strip_currency, quoted
from ledgerlens.sources.tables import freed_shuffles

# The canonical tables.
SCHEMAS = {
    "transactions": (
        "tenant_id string, external_id string, customer_id string, offering_id string, transaction_date date, quantity double, "
        "unit_price double, total_amount double, cost double, profit double"),
    "customers": (
        "id string, tenant_id string, external_id string, external_id_hash string, name string, email_hash string, first_seen date, "
        "last_seen date, total_transactions bigint, total_revenue double"),
    "offerings": (
        "id string, tenant_id string, external_id string, name string, description string, category string, offering_type string, "
        "offering_type_confidence double, unit_cost double"),
    "interactions": (
        "id string, tenant_id string, customer_id string, offering_id string, interaction_type string, interaction_date date, "
        "content string, sentiment_score double, rating double, topics array<string>"),
    "metrics_daily": (
        "tenant_id string, metric_date date, offering_id string, revenue double, cost double, profit double, transaction_count bigint, "
        "unique_customers bigint, avg_order_value double"),
    "insights": (
        "insight_type string, severity string, title string, description string, "
        "evidence struct<revenue: double, profit: double, margin: double, transactions: bigint>, recommendation string, "
        "expected_impact string, confidence double, is_dismissed boolean, created_at timestamp"),
    "column_mappings": (
        "dataset_id string, original_column string, canonical_field string, confidence double, confirmed boolean"),
    "datasets": (
        "dataset_id string, filename string, row_count bigint, column_count bigint, columns string, updated_at timestamp"),
}


def schema_of(name: str) -> T.StructType:
    """Schema of a canonical table."""
    return T.StructType.fromDDL(SCHEMAS[name])


def surrogate(tenant: str, external: Column) -> Column:
    """Stable key of an external id within a tenant: the whole digest, so that no two ids merge."""
    return F.when(external.isNotNull(), F.sha2(F.concat(F.lit(tenant + ":"), external), 256))


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename confirmed columns to their canonical fields; ``mapping`` is original to canonical."""
    return df.select(*[quoted(o).alias(c) for o, c in mapping.items()])


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    if isinstance(df.schema[name].dataType, T.StringType):
        return strip_currency(F.col(name)).try_cast("double")
    return F.col(name).cast("double")


def transaction_day(df: DataFrame) -> Column:
    """Day of a transaction, null without a readable one."""
    when = to_timestamp_or_null(F.col("transaction_date"), df.schema["transaction_date"].dataType) if "transaction_date" in df.columns else F.lit(None)
    return when.cast("date")


def transactions(df: DataFrame, tenant: str) -> DataFrame:
    """Canonical transactions of a table that carries canonical names; profit is amount less cost."""
    amount, cost = _number(df, "amount"), _number(df, "cost")
    quantity = _number(df, "quantity")
    price = F.coalesce(_number(df, "unit_price"), F.try_divide(amount, quantity))
    return df.select(
        F.lit(tenant).alias("tenant_id"), _field(df, "transaction_id").cast("string").alias("external_id"),
        surrogate(tenant, _field(df, "customer_id").cast("string")).alias("customer_id"),
        surrogate(tenant, _field(df, "offering_id").cast("string")).alias("offering_id"), transaction_day(df).alias("transaction_date"),
        quantity.alias("quantity"), price.alias("unit_price"), amount.alias("total_amount"), cost.alias("cost"), (amount - cost).alias("profit"))


def customers(df: DataFrame, tenant: str) -> DataFrame:
    """One row per customer; external id and e-mail leave only as digests beside the id."""
    when = to_timestamp_or_null(F.col("transaction_date"), df.schema["transaction_date"].dataType).cast("date")
    key = F.col("customer_id").cast("string")
    grouped = df.where(F.col("customer_id").isNotNull()).groupBy(key.alias("external_id")).agg(
        F.min(_field(df, "customer_name")).alias("name"), F.min(_field(df, "customer_email")).alias("email"), F.min(when).alias("first_seen"),
        F.max(when).alias("last_seen"), F.count(F.lit(1)).alias("total_transactions"), F.sum(_number(df, "amount")).alias("total_revenue"))
    return grouped.select(
        surrogate(tenant, F.col("external_id")).alias("id"), F.lit(tenant).alias("tenant_id"), hashed(F.col("external_id")).alias("external_id_hash"),
        "name", hashed(F.lower("email")).alias("email_hash"), "first_seen", "last_seen", "total_transactions",
        rounded(F.col("total_revenue"), 4).alias("total_revenue"))


def offerings(df: DataFrame, tenant: str) -> DataFrame:
    """One row per offering."""
    key = F.col("offering_id").cast("string")
    grouped = df.where(F.col("offering_id").isNotNull()).groupBy(key.alias("external_id")).agg(
        F.min(_field(df, "offering_name")).alias("name"), F.min(_field(df, "offering_category")).alias("category"),
        F.avg(F.try_divide(_number(df, "cost"), _number(df, "quantity"))).alias("unit_cost"))
    return grouped.select(surrogate(tenant, F.col("external_id")).alias("id"), F.lit(tenant).alias("tenant_id"), "external_id", "name", "category",
                          rounded(F.col("unit_cost"), 4).alias("unit_cost"))


#: Rows of a day that go to one file, about.
DAY_ROWS = 1_000_000


def _day_name(date: str) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def files_of_days(txn: DataFrame) -> dict[str, int]:
    """Files for the busy days, by the rows of transactions: a rollup of a day has no more rows than these."""
    with freed_shuffles(txn.sparkSession):
        busy = txn.groupBy(F.coalesce(_day_name("transaction_date"), F.lit("")).alias("day")).count().where(F.col("count") > DAY_ROWS).collect()
    return {r["day"]: -(-r["count"] // DAY_ROWS) for r in busy}


def write_daily_metrics(metrics: DataFrame, path: str, files: dict[str, int] | None = None) -> None:
    """Store the daily rollup by day; a rerun replaces the days it holds and no others.

    Range partitioning spreads a busy day over several files, at the cost of a second run of the rollup for a sample
    of its keys; with ``files`` (see ``files_of_days``) digests of the offerings do.  Digests take half the room in zstd.
    """
    daily = metrics.withColumn("metric_day", _day_name("metric_date"))
    if files is None:
        dealt = daily.repartitionByRange("metric_day", "offering_id")
    elif files:
        of_day = F.create_map(*[F.lit(x) for item in files.items() for x in item])
        dealt = daily.repartition("metric_day", F.pmod(F.hash("offering_id"), F.coalesce(of_day[F.coalesce("metric_day", F.lit(""))], F.lit(1))))
    else:
        dealt = daily.repartition("metric_day")
    with freed_shuffles(metrics.sparkSession):
        (dealt.sortWithinPartitions("metric_day")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("metric_day").parquet(path))


def read_daily_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The stored daily rollup, which may hold no day yet."""
    return spark.read.schema(schema_of("metrics_daily")).parquet(path)
