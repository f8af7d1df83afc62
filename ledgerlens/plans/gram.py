"""Correlations of wide tables from one masked Gram matrix.

Let X be the centred values (0 for a gap), Q their squares and M the presence of values, rows below each
other.  The sums that a pair of columns needs over the rows where both have values are cells of X'X, X'M, Q'M
and M'M, so one scan serves all pairs of a block of columns, gaps included.  Every task multiplies its batches
and hands on one partial matrix, a row of cells for each column; partial matrices are added a bounded number
at a time.  Two scans serve up to ``BLOCK`` columns; beyond it, each pair of blocks has a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.text import quoted
from ledgerlens.plans.ordered import staged

#: Columns of a block: a task holds four matrices of a block's columns squared.
BLOCK = 1024
#: Partial results that one group adds up.
PARTS = 256
#: Share of a column's square sum below which its spread over the common rows counts as none.
FLAT = 1e-12


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors ``cells`` of equal keys added, never more than PARTS in one group."""
    def add(table: pa.Table) -> pa.Table:
        total = np.sum([c.values.to_numpy() for c in table["cells"]], axis=0)
        first = table.slice(0, 1).select([*keys, "part"])
        return first.append_column("cells", pa.array([total], pa.list_(pa.float64())))

    schema = ", ".join(f"{k} int" for k in keys) + ", part int, cells array<double>"
    parts = staged(parts)
    number = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / PARTS).cast("int")).groupBy(*keys, "part").applyInArrow(add, schema)
        number = -(-number // PARTS)
        if number <= 1:
            return parts


def column_moments(df: DataFrame, names: list[str]) -> np.ndarray:
    """(rows, values, sum, smallest, largest) of each numeric column, as five rows; one scan."""
    size = len(names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.stack([np.zeros(size), np.zeros(size), np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)])
        for batch in batches:
            for i, column in enumerate(batch.columns):
                values = column.drop_null().to_numpy().astype(np.float64)
                out[0, i] += len(column)
                if len(values):
                    with np.errstate(invalid="ignore"):
                        out[:, i] = [out[0, i], out[1, i] + len(values), out[2, i] + values.sum(), np.minimum(out[3, i], values.min()), np.maximum(out[4, i], values.max())]
        yield pa.RecordBatch.from_arrays([pa.array([row.tolist() for row in out], pa.list_(pa.float64())), pa.array(range(5), pa.int32())], ["cells", "row"])

    slim = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    cells = slim.mapInArrow(partial, "cells array<double>, row int").select("row", F.posexplode("cells").alias("i", "v"))
    told = cells.groupBy("row", "i").agg(F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")).collect()  # five rows a column
    out = np.zeros((5, size))
    for r in told:
        out[r["row"], r["i"]] = r[{3: "min", 4: "max"}.get(r["row"], "sum")]
    return out


def wide_correlations(df: DataFrame, names: list[str], block: int | None = None) -> DataFrame:
    """(a, b, x, y, r) for every pair of numeric columns, nulls dropped per pair; r is NULL where a side is constant or not finite."""
    block = block or BLOCK
    rows, counts, sums, low, high = column_moments(df, names)
    usable = np.isfinite(low) & np.isfinite(high) & np.isfinite(sums) & (counts > 0) & (low < high)
    means = np.where(usable, sums / np.maximum(counts, 1), 0.0)
    blocks = [range(at, min(at + block, len(names))) for at in range(0, len(names), block)]
    found = None
    for k, one in enumerate(blocks):
        for two in blocks[k:]:
            part = _block_pair(df, names, one, two, means, usable)
            found = part if found is None else found.unionByName(part)
    labels = F.array(*[F.lit(n) for n in names])
    return found.select("a", "b", labels[F.col("a")].alias("x"), labels[F.col("b")].alias("y"), "r")


def _block_pair(df: DataFrame, names: list[str], one: range, two: range, means: np.ndarray, usable: np.ndarray) -> DataFrame:
    """(a, b, r) for a in block ``one`` and a later b in block ``two``."""
    wanted = sorted({*one, *two})
    left, right = [wanted.index(i) for i in one], [wanted.index(j) for j in two]
    centre, kept = means[wanted], usable[wanted]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(left), len(right)))
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
            present = np.stack([~np.asarray(c.is_null()) for c in batch.columns], axis=1) & kept
            m = present.astype(np.float64)
            x = np.where(present, values - centre, 0.0)
            q = x * x
            (xa, qa, ma), (xb, qb, mb) = [[z[:, side] for z in (x, q, m)] for side in (left, right)]
            total += np.stack([ma.T @ mb, xa.T @ xb, xa.T @ mb, ma.T @ xb, qa.T @ mb, ma.T @ qb])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(one), pa.int32()), pa.array([part] * len(left), pa.int32()),
             pa.array([total[:, i, :].ravel() for i in range(len(left))], pa.list_(pa.float64()))], ["a", "part", "cells"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, cells in zip(batch["a"].to_pylist(), batch["cells"]):
                n, xy, sx, sy, xx, yy = cells.values.to_numpy().reshape(6, len(two))
                with np.errstate(invalid="ignore", divide="ignore"):
                    vx, vy = xx - sx * sx / n, yy - sy * sy / n
                    r = np.clip((xy - sx * sy / n) / np.sqrt(vx * vy), -1.0, 1.0)
                none = (n == 0) | (vx <= FLAT * xx) | (vy <= FLAT * yy) | ~usable[a] | ~usable[list(two)] | ~np.isfinite(r)
                later = np.array([j > a for j in two])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * int(later.sum()), pa.int32()), pa.array(np.array(two, np.int32)[later]), pa.array(r[later], mask=none[later])], ["a", "b", "r"])

    slim = df.select(*[quoted(names[i]).cast("double").alias(f"c{i}") for i in wanted])
    sums = _summed(slim.mapInArrow(partial, "a int, part int, cells array<double>"), ["a"])
    return sums.mapInArrow(read, "a int, b int, r double")
