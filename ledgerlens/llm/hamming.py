"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints at four or fewer differing bits agree in at least four of their eight
bytes.  One byte is too common a key, so a posting holds three positions and their bytes; twenty
such triples are chosen so that any four positions contain one of them.  Fingerprints that meet
in a posting list are compared there: their equal positional bytes are tallied, pairs with at
least the guaranteed four go on, and their differing bits are counted.

A list emits no pairs but a spanning forest of its links.  Long lists are cut into chunks of
fixed size that meet two at a time, so no task holds a whole list.  Equal fingerprints are one
row from the start.

Defined cases: a text that is null, empty or without words has fingerprint zero; rows without an
id take part, and a component's id is its smallest id that is not null (null if it has none);
repeated rows share their component; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import free_names, per_text, staged, worker_imports
from ledgerlens.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints of a chunk of a long posting list.
CHUNK = 512
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprints(texts: list[str], words: int = SHINGLE_WORDS) -> list[int]:
    """Fingerprint of each text, as a signed 64-bit number."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for index, text in enumerate(texts):
        parts = text.encode().translate(UPPER_TO_LOWER).split()
        if not parts:
            continue
        flat = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(digest(flat, 42))
            counts[index] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = [0, *(ends[:-words] + 1).tolist()]
        hashes.extend([digest(flat[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist())])
        counts[index] = len(starts)
    every = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(len(texts)) << 8, counts)
    out = np.zeros(len(texts), np.uint64)
    for position in range(8):
        tally = np.bincount(owner + every[:, position], minlength=len(texts) << 8).reshape(-1, 256)
        ones = tally @ BITS
        bits = (2 * ones > counts[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * position)
    return out.view(np.int64).tolist()


def simhash(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed 64-bit number."""
    @F.pandas_udf("bigint")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series(per_text(lambda part: fingerprints(part, words), texts), dtype="int64")

    return mark(text.cast("string"))


def byte_triples() -> list[tuple[int, int, int]]:
    """Twenty of the 56 triples of byte positions; any four positions contain one (Turan's construction)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    chosen = [g for g in groups if len(g) == 3]
    for k, group in enumerate(groups):
        following = groups[(k + 1) % 3]
        chosen += [tuple(sorted((*two, one))) for two in combinations(group, 2) for one in following]
    return sorted(chosen)


def postings(marks: DataFrame) -> DataFrame:
    """Column fp to (key, fp): one posting for each triple of positional bytes."""
    def key(number: int, places: tuple[int, int, int]) -> Column:
        out = F.lit(number).cast("bigint")
        for place in places:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * place).bitwiseAND(F.lit(255)))
        return out

    keys = F.array(*[key(n, t) for n, t in enumerate(byte_triples())])
    return marks.select("fp", F.explode(keys).alias("key"))


def spanning_links(marks: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that join what is joined among ``marks``: tally equal bytes, keep the guaranteed count, verify the bits."""
    values = marks.tolist()
    if len(values) == 2:
        differing = (values[0] ^ values[1]) & 0xFFFFFFFFFFFFFFFF
        return [(values[0], values[1])] if differing.bit_count() <= most else []
    octets = marks.view(np.uint8).reshape(-1, 8)
    waiting, links = np.arange(len(values)), []
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            shared = (octets[waiting] == octets[at]).sum(axis=1)
            near = shared >= 8 - most
            near[near] = np.bitwise_count((marks[waiting[near]] ^ marks[at]).view(np.uint64)) <= most
            links += [(values[at], values[x]) for x in waiting[near].tolist()]
            queue.extend(waiting[near].tolist())
            waiting = waiting[~near]
    return links


def hamming_links(marks: DataFrame, most: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (column fp) to links (a, b) with the same components as all pairs within ``most`` bits."""
    if not 0 <= most <= 4:
        raise ValueError("the index guarantees matches up to 4 differing bits")
    worker_imports(marks.sparkSession)
    entries = postings(marks)
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = entries.join(shared, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    lists = lists.withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: (c != F.col("own")) | (F.col("chunks") == 1))
    meets = lists.withColumn("other", F.explode(others)).groupBy(
        "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")).agg(F.collect_list("fp").alias("fps"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = {pair for fps in batch["fps"] if len(fps) > 1 for pair in spanning_links(np.sort(np.asarray(fps, np.int64)), most)}
            yield pd.DataFrame(sorted(links), columns=["a", "b"], dtype="int64")

    return meets.select("fps").mapInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MAX_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, text_mark (XXH64 of the text), fp, grp (one value per component), component_id."""
    worker_imports(docs.sparkSession)
    body = F.col(f"`{text}`").cast("string")
    rows = staged(docs.select(F.col(f"`{key}`").alias(key), F.xxhash64(body).alias("text_mark"), simhash(body, words).alias("fp")), "simhash")
    marks = staged(rows.groupBy("fp").agg(F.min(key).alias("first")), "marks")
    found = components(hamming_links(marks.select("fp"), most)).withColumnRenamed("node", "fp")
    labelled = marks.join(found, "fp", "left").withColumn("grp", F.coalesce("label", "fp"))
    smallest = labelled.groupBy("grp").agg(F.min("first").alias("component_id"))
    classes = staged(labelled.select("fp", "grp").join(smallest, "grp"), "classes")
    return rows.join(classes, "fp")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """Documents (doc_id, text and any other columns) with one left of each component: the one with the smallest id.

    Of rows that share that id, or in a component without ids, the row with the smallest digest of its text stays.
    """
    mark, key, told = free_names(docs.columns, "_mark", "_key", "_told")
    rows = staged(near_duplicates(docs, words, most).select("doc_id", "text_mark", "grp"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_mark")
    stay = staged(rows.groupBy("grp").agg(F.min(order).alias("stay")).select("stay.doc_id", "stay.text_mark"), "stay")
    repeated = staged(rows.groupBy("doc_id", "text_mark").count().filter("count > 1"), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col(mark).eqNullSafe(F.col(told))

    def named(side: DataFrame) -> DataFrame:
        return side.select(F.col("doc_id").alias(key), F.col("text_mark").alias(told))

    kept = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).join(named(stay), same, "left_semi")
    if repeated.isEmpty():
        return kept.drop(mark)
    once = kept.join(named(repeated), same, "left_semi").dropDuplicates(["doc_id", mark])
    return kept.join(named(repeated), same, "left_anti").unionByName(once).drop(mark)
