"""Helpers shared by the operators: staging, worker imports and batches of bounded size."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.sources.tables import shared_folder

HELD_OUT_FOLDS = 5
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_held: dict[str, Any] = {}


def worker_imports(spark: SparkSession) -> None:
    """Prepare a session for Python workers over long texts: small batches, unless it has a size of its own.

    On a local master, workers also import this package from where the driver has it.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if context.master.startswith("local") and root not in context.environment.get("PYTHONPATH", ""):
        context.environment["PYTHONPATH"] = root


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers for one operator; the next operator's takes its place.

    Workers are used again by later stages, which should not find their memory full.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result to the cluster's shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with no name in ``taken`` (names differ in more than case)."""
    known, out = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS == 0, F.lit(False))


def by_size(texts: Iterable[str], chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts in lists of about ``chars`` code points, each with the index of its first."""
    first, held, size = 0, [], 0
    for index, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= chars:
            yield first, held
            first, held, size = index + 1, [], 0
    if held:
        yield first, held


def per_text(function: Callable[[list[str]], list], texts: pd.Series) -> list:
    """Apply a function of a list of texts (null read as empty) in lists of bounded size."""
    out: list = []
    for _, part in by_size(texts.fillna("")):
        out.extend(function(part))
    return out
