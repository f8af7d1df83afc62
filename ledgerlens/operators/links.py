"""Join keys between tables, found from the values they share.

All tables are read once into (value -> set of columns that hold it), kept as
bit masks that combine map-side; counting equal masks then leaves a handful of
rows that give the distinct count of every column and the overlap of every pair
of columns.  No pair of tables is joined and no value emits pairs of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.numbers import ratio, rounded
from ledgerlens.functions.text import indel_ratio, quoted, spaced
from ledgerlens.plans.catalog import ColumnInfo, columns_of, local_table, union_all, value_key
from ledgerlens.plans.ordered import staged

BITS = 62
# Name fragments of each kind of linkable column, in order of precedence.
LINK_WORDS = (
    ("id", ("id", "key", "code", "number", "no", "num")),
    ("customer", ("customer", "client", "user", "account", "buyer", "member")),
    ("product", ("product", "item", "sku", "goods", "article")),
    ("order", ("order", "transaction", "purchase", "po")),
    ("employee", ("employee", "staff", "worker", "emp")),
    ("ticket", ("ticket", "case", "issue", "incident")),
    ("invoice", ("invoice", "bill", "receipt")),
    ("date", ("date", "time", "timestamp", "created", "updated")),
)
# Suffixes stripped before names are compared.
KEY_SUFFIXES = ("_id", "id", "_key", "key", "_code", "code")


Slot = tuple[int, str, ColumnInfo]


def comparable(datasets: dict[str, DataFrame]) -> list[Slot]:
    """(dataset position, dataset, column) of every column with comparable values."""
    return [(p, name, c) for p, (name, df) in enumerate(datasets.items()) for c in columns_of(df) if c.kind != "nested"]


def value_masks(datasets: dict[str, DataFrame], slots: list[Slot]) -> DataFrame:
    """(masks, n): how many distinct values occur in exactly this set of columns."""
    words = (len(slots) + BITS - 1) // BITS
    parts = []
    for name, df in datasets.items():
        cells = [
            F.struct(value_key(c).alias("value"), F.lit(i // BITS).alias("word"), F.lit(1 << (i % BITS)).cast("bigint").alias("bit"))
            for i, (_, owner, c) in enumerate(slots) if owner == name
        ]
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))))
    long = union_all(parts)
    masks = long.where(F.col("value").isNotNull()).groupBy("value").agg(*[
        F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in range(words)
    ])
    names = [f"m{w}" for w in range(words)]
    return masks.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(F.array(*names).alias("masks"), "n")


def _has(masks: Column, slot: Column) -> Column:
    word = F.element_at(masks, (F.floor(slot / BITS) + 1).cast("int"))
    return word.bitwiseAND(F.element_at(F.lit([1 << b for b in range(BITS)]).cast("array<bigint>"), (slot % BITS + 1).cast("int"))) != 0


def _members(patterns: DataFrame, slots: int) -> DataFrame:
    """One row per pattern and column in it."""
    inside = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: _has(F.col("masks"), i))
    return patterns.select("masks", "n", F.explode(inside).alias("slot"))


def link_catalog(datasets: dict[str, DataFrame], slots: list[Slot], patterns: DataFrame) -> DataFrame:
    """(slot, position, dataset, ordinal, column, dtype, kind, rows, distinct) of the compared columns."""
    counts = union_all([
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows") for name, df in datasets.items()])
    session = next(iter(datasets.values())).sparkSession
    known = local_table(
        session, [(i, p, name, c.ordinal, c.name, c.dtype, c.kind) for i, (p, name, c) in enumerate(slots)],
        "slot int, position int, dataset string, ordinal int, `column` string, dtype string, kind string",
    )
    distinct = _members(patterns, len(slots)).groupBy("slot").agg(F.sum("n").alias("distinct"))
    return known.join(counts, "dataset").join(distinct, "slot", "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0).cast("bigint")))


def _survey(datasets: dict[str, DataFrame], slots: list[Slot]) -> tuple[DataFrame, DataFrame]:
    """Value masks and column catalog of the columns worth comparing.

    The masks are the outcome of the one heavy job, a few hundred rows at most
    in practice; they are staged so that it runs once.  The catalog has one row
    per column and is kept as a local table.
    """
    patterns = staged(value_masks(datasets, slots))
    catalog = link_catalog(datasets, slots, patterns)
    return patterns, local_table(catalog.sparkSession, catalog.collect(), catalog.schema)


def _paired_by_name(datasets: dict[str, DataFrame], match: Column) -> list[Slot]:
    """Columns whose name matches that of a column in another table; the others need no scan."""
    slots = comparable(datasets)
    session = next(iter(datasets.values())).sparkSession
    names = local_table(session, [(i, p, c.name) for i, (p, _, c) in enumerate(slots)], "slot int, position int, `column` string")
    left = names.select(*[F.col(c).alias(f"a_{c}") for c in names.columns])
    right = names.select(*[F.col(c).alias(f"b_{c}") for c in names.columns])
    pairs = left.join(right, (F.col("a_position") < F.col("b_position")) & match)
    wanted = {r["slot"] for r in pairs.select(F.explode(F.array("a_slot", "b_slot")).alias("slot")).distinct().collect()}
    return [s for i, s in enumerate(slots) if i in wanted]


def _link_slots(datasets: dict[str, DataFrame]) -> list[Slot]:
    """Columns that may turn out linkable: by name, or as text or whole numbers."""
    words = [w for _, group in LINK_WORDS for w in group]
    return [
        s for s in comparable(datasets)
        if s[2].kind == "string" or s[2].dtype in ("tinyint", "smallint", "int", "bigint")
        or any(w in s[2].name.lower().replace("_", " ").replace("-", " ") for w in words)
    ]


def link_type(name: Column, kind: Column, dtype: Column, distinct: Column, rows: Column) -> Column:
    """Kind of link a column can make, or NULL."""
    plain = spaced(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, fragments in LINK_WORDS:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | plain.contains(fragment)
        out = out.when(hit, label)
    keyish = (kind == "string") | dtype.isin("tinyint", "smallint", "int", "bigint")
    return out.when(keyish & (ratio(distinct, rows) > 0.8), "id")


def linkable_columns(datasets: dict[str, DataFrame]) -> DataFrame:
    """Columns that could link tables, with the kind of link."""
    _, catalog = _survey(datasets, _link_slots(datasets))
    return catalog.withColumn("link_type", link_type(*[F.col(c) for c in ("column", "kind", "dtype", "distinct", "rows")])).where(
        F.col("link_type").isNotNull()).select("dataset", "column", "link_type", "distinct", "rows")


def _candidates(catalog: DataFrame, match, extra: list[str]) -> DataFrame:
    """Column pairs of different tables that ``match`` accepts; as many rows as column pairs."""
    cols = ["slot", "position", "dataset", "ordinal", "column", "rows", "distinct", *extra]
    left = catalog.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    right = catalog.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    return left.join(right, (F.col("a_position") < F.col("b_position")) & match)


def _overlaps(candidates: DataFrame, patterns: DataFrame, slots: int) -> DataFrame:
    """Candidates that share values, with the number of shared values."""
    shared = (
        _members(patterns, slots).join(candidates.select("a_slot", "b_slot"), F.col("slot") == F.col("a_slot"))
        .where(_has(F.col("masks"), F.col("b_slot"))).groupBy("a_slot", "b_slot").agg(F.sum("n").alias("matched"))
    )
    return candidates.join(shared, ["a_slot", "b_slot"])


def _lower(name: str) -> Column:
    return F.lower(F.col(name))


def validate_links(datasets: dict[str, DataFrame]) -> DataFrame:
    """Compatible column pairs that share values: overlap, strength, confidence, issues."""
    slots = _link_slots(datasets)
    patterns, catalog = _survey(datasets, slots)
    catalog = catalog.withColumn(
        "link_type", link_type(*[F.col(c) for c in ("column", "kind", "dtype", "distinct", "rows")])).where(F.col("link_type").isNotNull())
    a, b = _lower("a_column"), _lower("b_column")
    types = F.col("a_link_type"), F.col("b_link_type")
    compatible = (types[0] == types[1]) | (types[0] == "id") | (types[1] == "id") | b.contains(a) | a.contains(b)
    pairs = _overlaps(_candidates(catalog, compatible, ["link_type"]), patterns, len(slots))
    left, right = ratio(F.col("matched"), F.col("a_distinct")) * 100, ratio(F.col("matched"), F.col("b_distinct")) * 100
    best = F.greatest(left, right)
    missing = F.col("a_distinct") - F.col("matched")
    issues = F.concat_ws(
        "; ", F.when((best < 50) & (missing > 0), F.concat(missing.cast("string"), F.lit(" values from source not found in target"))),
        F.when((left < 20) & (right < 20), "Very low overlap in both directions - possible data mismatch"))
    strength = F.when(best >= 80, "strong").when(best >= 50, "moderate").when(best >= 20, "weak").otherwise("broken")
    return pairs.select(
        F.col("a_position").alias("source_position"), F.col("b_position").alias("target_position"),
        F.col("a_ordinal").alias("source_ordinal"), F.col("b_ordinal").alias("target_ordinal"),
        F.col("a_dataset").alias("source"), F.col("b_dataset").alias("target"), F.col("a_column").alias("source_column"),
        F.col("b_column").alias("target_column"), strength.alias("strength"), rounded(best, 1).alias("overlap"),
        F.col("matched").alias("matched_count"), F.col("a_distinct").alias("source_unique"), F.col("b_distinct").alias("target_unique"),
        rounded(F.least(best, F.lit(95.0)), 1).alias("confidence"), issues.alias("issues"),
    )


PLACES = ("source_position", "target_position", "source_ordinal", "target_ordinal")


def best_links(links: DataFrame) -> DataFrame:
    """The strongest link per pair of tables; the first column pair wins ties."""
    order = Window.partitionBy("source_position", "target_position").orderBy(
        F.col("overlap").desc(), "source_ordinal", "target_ordinal")
    return links.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def link_health(links: DataFrame) -> DataFrame:
    """Score, status and counts over the best links."""
    sums = best_links(links).agg(
        F.count(F.lit(1)).alias("total_links"), F.count_if(F.col("strength") == "strong").alias("strong_links"),
        F.avg("overlap").alias("overlap"))
    score = F.coalesce(F.col("overlap") * 0.7 + ratio(F.col("strong_links"), F.col("total_links")) * 30, F.lit(0.0))
    status = (
        F.when(F.col("total_links") == 0, "no_links").when(score >= 80, "excellent").when(score >= 60, "good")
        .when(score >= 40, "fair").otherwise("poor"))
    return sums.select(rounded(score, 1).alias("health_score"), status.alias("health_status"), "total_links", "strong_links")


def link_warnings(links: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Weak and broken best links, and tables without any link."""
    best = best_links(links)
    share = F.format_number("overlap", 1)
    columns = F.concat(F.col("source_column"), F.lit(" and "), F.col("target_column"))
    broken = F.col("strength") == "broken"
    shaky = best.where(F.col("strength").isin("broken", "weak")).select(
        F.when(broken, "broken_link").otherwise("weak_link").alias("type"), F.when(broken, "high").otherwise("medium").alias("severity"),
        F.when(broken, F.concat(F.lit("Weak connection between datasets: Only "), share, F.lit("% overlap between "), columns))
        .otherwise(F.concat(F.lit("Limited connection: "), share, F.lit("% overlap between "), columns)).alias("message"),
        F.concat_ws(",", "source", "target").alias("datasets"))
    names = local_table(links.sparkSession, [(n,) for n in datasets], "dataset string")
    linked = best.select(F.explode(F.array("source", "target")).alias("dataset"))
    alone = names.join(linked, "dataset", "left_anti").select(
        F.lit("isolated_dataset").alias("type"), F.lit("high").alias("severity"),
        F.lit("Dataset has no connections to other uploaded files").alias("message"), F.col("dataset").alias("datasets"))
    return shaky.unionByName(alone)


def link_nodes(datasets: dict[str, DataFrame]) -> DataFrame:
    """(id, rows, columns) per table."""
    out = None
    for name, df in datasets.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("id"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


def link_edges(links: DataFrame) -> DataFrame:
    return best_links(links).select("source", "target", "strength", "overlap", "source_column", "target_column")


def cardinality(distinct_a: Column, rows_a: Column, distinct_b: Column, rows_b: Column) -> Column:
    one = ratio(distinct_a, F.greatest(rows_a, F.lit(1))) > 0.9
    other = ratio(distinct_b, F.greatest(rows_b, F.lit(1))) > 0.9
    return (F.when(one & other, "one_to_one").when(one, "one_to_many").when(other, "many_to_one").otherwise("many_to_many"))


def infer_relationships(datasets: dict[str, DataFrame], per_pair: int = 5) -> DataFrame:
    """Likely joins from similar names and shared values, at most five per pair of tables.

    Overlap is measured on all distinct values.
    """
    a, b = _lower("a_column"), _lower("b_column")
    similar = indel_ratio(a, b)
    ids = (a.contains("id") & b.contains("id")) | (a.endswith("_id") & b.endswith("_id")) | (a == b)
    slots = _paired_by_name(datasets, (similar > 0.7) | ids) or comparable(datasets)[:1]
    patterns, catalog = _survey(datasets, slots)
    pairs = _candidates(catalog, (similar > 0.7) | ids, [])
    pairs = pairs.withColumn("similarity", similar).withColumn("ids", ids)
    shared = _overlaps(pairs, patterns, len(slots))
    overlap = ratio(F.col("matched"), F.least("a_distinct", "b_distinct"))
    sure = F.least(F.col("similarity") * 0.4 + overlap * 0.4 + F.when(F.col("ids"), 0.2).otherwise(0.0), F.lit(0.99))
    found = shared.where(overlap > 0.3).withColumn("confidence", rounded(sure, 2)).withColumn("overlap", overlap)
    order = Window.partitionBy("a_position", "b_position").orderBy(F.col("confidence").desc(), "a_ordinal", "b_ordinal")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_pair).select(
        F.col("a_dataset").alias("source_dataset"), F.col("a_column").alias("source_column"), F.col("b_dataset").alias("target_dataset"),
        F.col("b_column").alias("target_column"), "confidence",
        cardinality(F.col("a_distinct"), F.col("a_rows"), F.col("b_distinct"), F.col("b_rows")).alias("cardinality"),
        rounded(F.col("overlap"), 2).alias("overlap_score"), rounded(F.col("similarity"), 2).alias("name_similarity"))


def graph_nodes(relationships: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(id, role) of every related table; ``roles`` has columns dataset and role."""
    nodes = relationships.select(F.explode(F.array("source_dataset", "target_dataset")).alias("id")).distinct()
    if roles is None:
        return nodes.withColumn("role", F.lit("unknown"))
    return nodes.join(roles.select(F.col("dataset").alias("id"), "role"), "id", "left").select(
        "id", F.coalesce("role", F.lit("unknown")).alias("role"))


def graph_edges(relationships: DataFrame) -> DataFrame:
    return relationships.where(F.col("confidence") > 0.5).select(
        F.col("source_dataset").alias("source"), F.col("target_dataset").alias("target"), "source_column", "target_column",
        "cardinality", "confidence")


def _stem(name: Column) -> Column:
    """Name without its key suffixes, as a fold so that the expression does not repeat itself."""
    def strip(rest: Column, suffix: Column) -> Column:
        return F.when(F.endswith(rest, suffix), F.replace(rest, suffix, F.lit(""))).otherwise(rest)

    return F.aggregate(F.array(*[F.lit(x) for x in KEY_SUFFIXES]), name, strip)


def find_relationships(datasets: dict[str, DataFrame]) -> DataFrame:
    """Potential joins of columns with the same name stem and over 30 % shared values."""
    a, b = _stem(_lower("a_column")), _stem(_lower("b_column"))
    match = (F.col("a_column") == F.col("b_column")) | a.contains(b) | b.contains(a)
    slots = _paired_by_name(datasets, match) or comparable(datasets)[:1]
    patterns, catalog = _survey(datasets, slots)
    shared = _overlaps(_candidates(catalog, match, []), patterns, len(slots))
    overlap = ratio(F.col("matched"), F.least("a_distinct", "b_distinct"))
    return shared.where(overlap > 0.3).select(
        F.col("a_dataset").alias("dataset1"), F.col("a_column").alias("column1"), F.col("b_dataset").alias("dataset2"),
        F.col("b_column").alias("column2"), rounded(overlap, 4).alias("overlap"), F.lit("potential_join").alias("type"))


def concat_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """All rows below each other by column name; missing columns are NULL."""
    out = None
    for df in datasets.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def value_sets(left: DataFrame, left_col: str, right: DataFrame, right_col: str, kind: str = "intersect") -> DataFrame:
    """Distinct text values in both columns, or in the left one only."""
    a = left.select(quoted(left_col).cast("string").alias("value")).where(F.col("value").isNotNull())
    b = right.select(quoted(right_col).cast("string").alias("value")).where(F.col("value").isNotNull())
    return a.intersect(b) if kind == "intersect" else a.subtract(b)
