"""Exact inner-product search over whole-number vectors by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it.  In the order of these keys the
vectors are cut into annuli of bounded size, each with its range of distances and its largest norm.
By the triangle inequality, a query at distance D from a pivot is no nearer than max(D - far, near - D)
to any vector of an annulus, and 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2, which bounds the annulus's best
score.  A first pass looks only at annuli around the query's own key and gives each query a score that
its k-th result cannot fall below; the second pass expands to exactly those annuli whose bound reaches
it and stops there.  All rows are indexed; pivots come from a bounded sample and do not change results.

Queries travel in blocks; scores come from one matrix product for each pair of blocks.

Defined cases: a null vector, or one that holds a null, infinite or NaN component, takes no part, nor
does a row without an id; vectors meet only vectors of their own length; components are
floor(1024 * x), which must be finite; scores outside 64 bits are held at its ends; equal vectors are results of their own;
rows with the query's id are not its results; of rows that share a query's id, the first in key order asks; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.common import staged, worker_imports

SCALE = 1024
#: Bounds of the pivot sample, the pivots of one vector length, and the rows of an annulus and a query block.
SAMPLE, PIVOTS, ANNULUS, QUERY_BLOCK = 2000, 32, 1024, 128
ROWS_PER_TASK = 20_000
#: Relative slack of bounds, far above the rounding of a distance.
SLACK = 1e-6


def whole(vectors: list[np.ndarray]) -> np.ndarray:
    return np.floor(np.stack(vectors).astype(np.float64) * SCALE)


def choose_pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    chosen = [0]
    away = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(count, len(vectors)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (vectors ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * vectors @ pivots.T
        return np.nan_to_num(np.sqrt(np.maximum(squares, 0)), nan=np.inf, posinf=np.inf)


def _keyed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, dim, pivot, distance, norm and the whole-number vector as bytes."""
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                values = whole(part["vector"].tolist())
                apart = distances(values, pivots.get(dim, np.zeros((1, dim))))
                pivot = apart.argmin(1)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].array, "dim": dim, "pivot": pivot, "distance": apart[np.arange(len(pivot)), pivot],
                    "norm": np.sqrt((values ** 2).sum(1)), "body": [v.tobytes() for v in values]})

    return vectors.mapInPandas(key, "vec_id bigint, dim int, pivot int, distance double, norm double, body binary")


def _blocks(rows: DataFrame, size: int, tasks: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Runs of at most ``size`` rows in key order that share length and pivot."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = 0, None

        def block(part: pd.DataFrame) -> dict:
            nonlocal number
            number += 1
            dim = int(part["dim"].iloc[0])
            values = np.frombuffer(b"".join(part["body"]), np.float64).reshape(len(part), dim)
            apart = distances(values, pivots.get(dim, np.zeros((1, dim))))
            return {"block": (TaskContext.get().partitionId() << 32) + number, "dim": dim, "pivot": int(part["pivot"].iloc[0]),
                    "near": float(part["distance"].min()), "far": float(part["distance"].max()), "norm": float(part["norm"].max()),
                    "lows": apart.min(0).tolist(), "highs": apart.max(0).tolist(),
                    "ids": part["vec_id"].to_numpy(np.int64).tobytes(), "body": values.tobytes()}

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(held):
                continue
            made, change = [], ((held["dim"].diff() != 0) | (held["pivot"].diff() != 0)).to_numpy()
            edges = [*np.flatnonzero(change).tolist(), len(held)]
            for start, end in zip(edges, edges[1:]):
                last = end == len(held)
                while end - start > size or (end > start and not last):
                    made.append(block(held.iloc[start:min(start + size, end)]))
                    start = min(start + size, end)
            held = held.iloc[start:].reset_index(drop=True)
            if made:
                yield pd.DataFrame(made)
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    sort = ["dim", "pivot", "distance", "vec_id"]
    return rows.repartitionByRange(tasks, *sort).sortWithinPartitions(*sort).mapInPandas(
        cut, "block bigint, dim int, pivot int, near double, far double, norm double, lows array<double>, highs array<double>, ids binary, body binary")


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit numbers: one matrix product where doubles are exact, whole numbers beyond."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if reach < 2.0 ** 53:
        return (queries @ vectors.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    exact = big(queries) @ big(vectors).T if queries.size and vectors.size else np.zeros((len(queries), len(vectors)), object)
    return np.clip(exact, -2**63, 2**63 - 1).astype(np.int64)


def best(own: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, ~own))[:k]


def _search(pairs: DataFrame, k: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Scores of the pairs of query block and annulus that can still count, k at most for a query and annulus."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                names, least = np.frombuffer(row.q_ids, np.int64), np.asarray(row.q_least, np.int64)
                queries = np.frombuffer(row.q_body, np.float64).reshape(len(names), row.dim)
                apart = distances(queries, pivots.get(row.dim, np.zeros((1, row.dim))))[:, row.pivot]
                asked = np.flatnonzero(reaches((queries ** 2).sum(1), apart, apart, row.near, row.far, row.norm, least))
                ids = np.frombuffer(row.ids, np.int64)
                found = scores(queries[asked], np.frombuffer(row.body, np.float64).reshape(len(ids), row.dim))
                for at, own in zip(asked.tolist(), found):
                    usable = np.flatnonzero((own >= least[at]) & (ids != names[at]))
                    usable = usable[best(own[usable], ids[usable], k)]
                    out.append(pd.DataFrame({"query_id": names[at], "vec_id": ids[usable], "score": own[usable]}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return pairs.mapInPandas(search, "query_id bigint, vec_id bigint, score bigint")


def reaches(squares, low, high, near, far, norm, least):
    """Whether an annulus can hold a score of ``least`` for a query at a distance from low to high of its pivot."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(0.0, np.maximum(low - far, near - high))
        bound = (squares + norm * norm - gap * gap) / 2
        return ~(bound + SLACK * (squares + norm * norm + 1) < least)  # an undefined bound rules nothing out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
          annulus: int = ANNULUS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of ``vectors``; both tables have the key and the vector."""
    spark = vectors.sparkSession
    worker_imports(spark)

    def usable(df: DataFrame) -> DataFrame:
        slim = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
        sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf")))
        return slim.filter(F.col("vec_id").isNotNull() & sound)

    rows, asked = usable(vectors), usable(queries)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(len(row["vector"]), []).append(row["vector"])
    pivots = {dim: choose_pivots(whole([np.asarray(v) for v in own])) for dim, own in by_dim.items()}

    keyed = staged(_keyed(rows, pivots), "keys")
    tasks = max(1, -(-keyed.count() // ROWS_PER_TASK))
    index = staged(_blocks(keyed, annulus, tasks, pivots).drop("lows", "highs"), "annuli")
    columns = ["dim", "pivot", "distance", "norm", "body"]
    wanted = staged(_keyed(asked, pivots).groupBy("vec_id").agg(F.min(F.struct(*columns)).alias("own")).select("vec_id", "own.*"), "asked")
    blocks = staged(_blocks(wanted, query_block, max(1, -(-wanted.count() // ROWS_PER_TASK)), pivots), "queries").select(
        F.col("block").alias("q_block"), "dim", F.col("pivot").alias("q_pivot"), F.col("near").alias("q_near"), F.col("far").alias("q_far"),
        F.col("norm").alias("q_norm"), "lows", "highs", F.col("ids").alias("q_ids"), F.col("body").alias("q_body"))
    index_body = ["block", "dim", "pivot", "near", "far", "norm", "ids", "body"]
    query_body = ["q_block", "dim", "q_ids", "q_body"]

    # first pass: annuli that overlap the block's own range of distances; no score is needed yet
    around = blocks.select(*query_body, "q_pivot", "q_near", "q_far").join(index, "dim").filter(
        "q_pivot = pivot and near <= q_far and far >= q_near")
    none = np.iinfo(np.int64).min
    starting = around.withColumn("q_least", F.expr(f"array_repeat(cast({none + 1} as bigint), cast(length(q_ids) / 8 as int))"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = _search(starting.select(*query_body, "q_least", *index_body[:1], *index_body[2:]), k, pivots)
    kth = staged(first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).groupBy("query_id").agg(
        F.max("score").alias("least")), "least")

    # second pass: each query's least score goes back to its block, which visits every annulus in reach
    places = blocks.select("q_block", "q_ids").mapInPandas(_members, "q_block bigint, place int, query_id bigint")
    known = places.join(kth, "query_id", "left").groupBy("q_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("least", F.lit(none + 1)).alias("least")))),
                    lambda s: s["least"]).alias("q_least"))
    known = staged(known.withColumn("q_lowest", F.array_min("q_least")), "known")
    directory = index.select("block", "dim", "pivot", "near", "far", "norm")
    gap = F.greatest(F.lit(0.0), F.expr("lows[pivot]") - F.col("far"), F.col("near") - F.expr("highs[pivot]"))
    squares = F.col("q_norm") * F.col("q_norm") + F.col("norm") * F.col("norm")
    reach = (squares - gap * gap) / 2 + SLACK * (squares + 1) >= F.col("q_lowest")
    pairs = blocks.drop("q_ids", "q_body").join(known.select("q_block", "q_lowest"), "q_block").join(directory, "dim").filter(reach).select("q_block", "block")
    joined = pairs.join(index, "block").join(blocks.select("q_block", "q_ids", "q_body"), "q_block").join(known.select("q_block", "q_least"), "q_block")
    second = _search(joined.select(*query_body, "q_least", *index_body[:1], *index_body[2:]), k, pivots)
    return second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = [pd.DataFrame({"q_block": b, "place": np.arange(len(i) // 8, dtype=np.int32), "query_id": np.frombuffer(i, np.int64)})
                 for b, i in zip(batch["q_block"], batch["q_ids"])]
        if parts:
            yield pd.concat(parts, ignore_index=True)

