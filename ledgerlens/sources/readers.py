"""File readers: CSV, JSON in its usual shapes, prediction files, file facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import quoted

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8",
             sampling: float = 1.0, fallback: str | None = "ISO-8859-1") -> DataFrame:
    """CSV with a header line.  Give a schema on large inputs; inference costs a pass.

    If some line does not read in the encoding, all are read in ``fallback``; finding that out
    costs a pass over the lines, which ``fallback=None`` saves.
    """
    if fallback and encoding.upper().replace("-", "") == "UTF8" and not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        encoding = fallback
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling).csv(path)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """An array of records, JSON lines, an object holding a record array, or one record.

    ``lines=None`` tries whole documents first and falls back to lines.
    """
    if lines:
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    if lines is None and (CORRUPT in df.columns or not df.columns):
        return spark.read.json(path)
    return unwrap_records(df)


def unwrap_records(df: DataFrame) -> DataFrame:
    """Rows of the first record array inside the documents, else the documents."""
    for field in df.schema.fields:
        dtype = field.dataType
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            return df.select(F.inline(quoted(field.name)))
    return df


def read_predictions(spark: SparkSession, path: str, preview: int | None = None) -> DataFrame:
    """Predictions as CSV unless the name says JSON or Parquet."""
    lowered = path.lower()
    if lowered.endswith((".json", ".jsonl")):
        df = read_json(spark, path)
    elif lowered.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = read_csv(spark, path)
    return df.limit(preview) if preview else df


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case column names and turn blanks into underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def file_info(df: DataFrame) -> DataFrame:
    """Row count, column count and column names; only the count touches data."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), F.lit(",".join(df.columns)).alias("columns")
    )


def load(spark: SparkSession, path: str, file_type: str, **options) -> DataFrame:
    """Read a file by its type and normalise its column names."""
    readers = {"csv": read_csv, "json": read_json, "parquet": lambda s, p: s.read.parquet(p)}
    if file_type not in readers:
        raise ValueError(f"Unsupported file type: {file_type}")
    return normalize_columns(readers[file_type](spark, path, **options))
