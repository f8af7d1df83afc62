"""Merkle manifest of a dataset as a rollup of nested structs.

A leaf is the digest of a row's columns.  Leaves of a source, in order of their key, are numbered; the
hexadecimal digits of the rank are the way from the root to the leaf.  A block holds the 4,096 nodes whose
ranks differ in the last three digits only.  Inside a block the digit columns are grouped away one after the
other, each grouping nesting the child structs of the one before, until the block is one nested row; a
transform of it gives the digests of its inner nodes.  The tops of the blocks are the nodes of the next tier,
and so on until a source is one node; the sources' tops are one more group of nodes, up to the root.

Proofs come down the same way: a tier's blocks are exploded digit by digit, each step adding the digests
beside the way, and every block of the tier below takes the row that its top became.  There are no joins:
nested blocks and the rows for them meet in one grouping by block.

Ranks need no window over a source: distinct leaves are cut into slices by range, numbered inside a slice,
and a slice's start is the sum of the counts before it.  Equal rows are one row with a number of copies up to
the block they go to, so neither a source nor a key with most of the rows lands in one task.

Defined cases: nulls are ``-`` in a digest; keys that are null come first and are not tampered with; rows
with equal keys are ordered by their digest; equal rows have a leaf each; a null source is a source of its
own and the first one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import HELD_OUT_FOLDS, staged

#: Nodes under one parent: one hexadecimal digit of the rank.
FAN, BITS = 16, 4
#: Digits of a block: 4,096 nodes.
DIGITS = 3
#: Distinct leaves that are numbered by one window.
ROWS_PER_SLICE = 50_000
#: Equal leaves that are written out by one generator row.
COPIES_PER_STEP = 1_024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def row_digest(*columns: Column) -> Column:
    """Digest of the columns' texts, each after its number of bytes; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def leaves(df: DataFrame, key: str, source: str, columns: list[str], text: str) -> DataFrame:
    """Distinct leaves: source, key, leaf, tampered (null: not tampered with) and their number of copies."""
    own = {c: F.col(f"`{c}`") for c in columns}
    told = F.coalesce(F.crc32(own[key].cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))
    other = row_digest(*[F.translate(own[c].cast("string"), UPPER, LOWER) if c == text else own[c] for c in columns])
    return df.select(own[source].alias("source"), own[key].alias("key"), row_digest(*own.values()).alias("leaf"), F.when(told, other).alias("tampered")).groupBy(
        "source", "key", "leaf", "tampered").agg(F.count(F.lit(1)).alias("copies"))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``rank``: the copies before them in their group, in the order of columns that are unique within it."""
    rows = staged(rows, "unranked")
    slices = max(1, -(-rows.count() // ROWS_PER_SLICE))
    by = [F.col(c).asc_nulls_first() for c in group + order]
    cut = staged(rows.repartitionByRange(slices, *by).withColumn("slice", F.spark_partition_id()), "slices")
    # a group that spans many slices has a row for each of them here
    counts = cut.groupBy(*group, "slice").agg(F.sum("copies").alias("n"))
    starts = counts.select(
        *[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.col("slice").alias("s"),
        (F.sum("n").over(Window.partitionBy(*group).orderBy("slice")) - F.col("n")).alias("start"))
    along = Window.partitionBy("slice", *group).orderBy(*by[len(group):]).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("before", F.sum("copies").over(along) - F.col("copies"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"g{i}")) for i, c in enumerate(group)], F.col("slice") == F.col("s"))
    return inside.join(starts, same).select(*rows.columns, (F.col("start") + F.col("before")).alias("rank"))


def spread(rows: DataFrame) -> DataFrame:
    """A row for each copy, with its own rank."""
    rows = staged(rows, "ranks")
    once = rows.filter("copies = 1").drop("copies")
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES_PER_STEP).cast("bigint"))
    some = rows.filter("copies > 1").withColumn("step", F.explode(steps)).repartition("rank", "step")
    more = some.withColumn("copy", F.explode(F.sequence(F.col("step"), F.least(F.col("step") + COPIES_PER_STEP, F.col("copies")) - 1)))
    return once.unionByName(more.withColumn("rank", F.col("rank") + F.col("copy")).select(*once.columns))


def nested(nodes: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """Blocks of nodes (columns ``rank``, ``node`` and ``carried``) as nested rows: group, block, tree, depth and the block's node."""
    digits = [F.shiftright("rank", BITS * level).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(f"d{level}") for level in range(DIGITS)]
    rows = nodes.select(*group, F.shiftright("rank", BITS * DIGITS).alias("block"), *digits, F.struct("node", *carried).alias("kid"))
    rows = rows.repartition(*group, "block")
    for level in range(DIGITS):
        left = [f"d{above}" for above in range(level + 1, DIGITS)]
        kids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"d{level}").alias("d"), "kid"))), lambda x: x["kid"])
        rows = rows.groupBy(*group, "block", *left).agg(kids.alias("kids")).withColumn("kid", F.struct("kids"))
    # a tree of one block is as deep as its ranks have digits; of several blocks, every one is whole
    tall, wide, some = F.size("kids") > 1, F.size(F.col("kids")[0]["kids"]) > 1, F.size(F.col("kids")[0]["kids"][0]["kids"]) > 1
    depth = F.when((F.col("block") > 0) | tall, 3).when(wide, 2).when(some, 1).otherwise(0)
    rows = rows.select(*group, "block", "kids", depth.alias("depth"))

    def parent(level: int, kids: Column) -> Column:
        """Digest of nodes below one parent; a level above the tree's depth passes its only node on."""
        return F.when(F.col("depth") >= level, sha(F.array_join(F.transform(kids, lambda k: k["node"]), ""))).otherwise(kids[0]["node"])

    low = F.transform("kids", lambda a: F.struct(F.transform(a["kids"], lambda b: F.struct(parent(1, b["kids"]).alias("node"), b["kids"].alias("kids"))).alias("kids")))
    high = F.transform("tree", lambda a: F.struct(parent(2, a["kids"]).alias("node"), a["kids"].alias("kids")))
    return rows.select(*group, "block", "depth", low.alias("tree")).withColumn("tree", high).select(
        *group, "block", "depth", "tree", parent(3, F.col("tree")).alias("node"))


def opened(blocks: DataFrame, group: list[str], given: list[str]) -> DataFrame:
    """A row for each node of nested blocks: group, rank, the kid, ``given`` columns, and ``path`` from the node to the root.

    Blocks have the path from their top on; each digit puts before it what stands left and right of its node.
    """
    rows = blocks.withColumn("rank", F.col("block")).withColumnRenamed("tree", "kids")
    for level in range(DIGITS, 0, -1):
        beside = F.transform("kids", lambda k: k["node"])
        rows = rows.select(*group, *given, "depth", "rank", "path", beside.alias("beside"), F.posexplode("kids").alias("at", "kid"))
        step = F.struct(F.array_join(F.slice("beside", F.lit(1), F.col("at")), "").alias("before"),
                        F.array_join(F.slice("beside", F.col("at") + 2, F.lit(FAN)), "").alias("after"))
        path = F.when(F.col("depth") >= level, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        rows = rows.select(*group, *given, "depth", (F.col("rank") * FAN + F.col("at")).alias("rank"), path.alias("path"),
                           *(["kid"] if level == 1 else ["kid.kids"]))
    return rows.select(*group, *given, "rank", "path", "kid")


def meet(blocks: DataFrame, above: DataFrame, group: list[str], given: list[str]) -> DataFrame:
    """Blocks with the path and the ``given`` columns of the row their top became: one of each has the same group and number."""
    down = above.select(*group, F.col("rank").alias("block"), F.struct("path", *given).alias("way"))
    both = blocks.select(*group, "block", F.struct("depth", "tree").alias("own")).unionByName(down, allowMissingColumns=True)
    one = both.groupBy(*group, "block").agg(F.first("own", ignorenulls=True).alias("own"), F.first("way", ignorenulls=True).alias("way"))
    return one.select(*group, "block", "own.depth", "own.tree", "way.path", *[f"way.{c}" for c in given])


def rolled_up(nodes: DataFrame, group: list[str], carried: list[str]) -> list[DataFrame]:
    """Tiers of nested blocks, from the nodes up to one block a group."""
    tiers = [staged(nested(nodes, group, carried), "blocks")]
    while (tiers[-1].agg(F.max("block")).first()[0] or 0) > 0:
        tiers.append(staged(nested(tiers[-1].select(*group, F.col("block").alias("rank"), "node"), group, []), "blocks"))
    return tiers


def handed_down(tiers: list[DataFrame], tops: DataFrame, group: list[str], given: list[str]) -> DataFrame:
    """Every node with its path, from the rows (rank 0) that the groups' tops became."""
    rows = tops
    for number, tier in reversed(list(enumerate(tiers))):
        rows = opened(meet(tier, rows, group, given), group, given)
        if number:
            rows = staged(rows.drop("kid"), "ways")
    return rows


def folded(node: Column, path: Column) -> Column:
    """The root that a node gives with the digests beside its way."""
    return F.aggregate(path, node, lambda one, step: sha(F.concat(step["before"], one, step["after"])))


def proofs(df: DataFrame, key: str = "doc_id", source: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
           text: str = "text") -> DataFrame:
    """A row for each row of ``df``: source, key, rank, leaf, tampered, subroot, root and path (what stands before and after, level by level)."""
    kind = dict(df.dtypes)[key]
    ranked = spread(numbered(leaves(df, key, source, list(columns), text), ["source"], ["key", "leaf"]))
    tiers = rolled_up(ranked.withColumnRenamed("leaf", "node"), ["source"], ["key", "tampered"])
    tops = tiers[-1].select(F.lit(0).alias("all"), "source", "node", F.lit(1).alias("copies"))
    heads = rolled_up(numbered(tops, ["all"], ["source"]), ["all"], ["source"])
    root = heads[-1].select("all", F.lit(0).cast("bigint").alias("rank"), F.col("node").alias("root"),
                            F.array().cast("array<struct<before: string, after: string>>").alias("path"))
    roots = handed_down(heads, root, ["all"], ["root"]).select(
        F.col("kid.source").alias("source"), F.lit(0).cast("bigint").alias("rank"), "path", F.col("kid.node").alias("subroot"), "root")
    rows = handed_down(tiers, staged(roots, "roots"), ["source"], ["subroot", "root"])
    return rows.select("source", F.col("kid.key").cast(kind).alias(key), "rank", F.col("kid.node").alias("leaf"), "kid.tampered", "subroot", "root", "path")


def manifest(df: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """Roots: a row for each source with its number of leaves, its subroot and the root of all."""
    return proofs(df, key, source, **options).groupBy("source", "subroot", "root").agg(F.count(F.lit(1)).alias("n_leaves"))


def checked(proofs: DataFrame) -> DataFrame:
    """Proofs with their digest, the root that the (tampered) leaf gives, and whether it is the root."""
    sides = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    return proofs.withColumn("proof_sha256", sha(sides)).withColumn(
        "folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
