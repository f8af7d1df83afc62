"""Document fingerprints by one-permutation MinHash, in column expressions only.

Each shingle of five words is hashed once.  The high bits of a hash name its bin, and a bin keeps
its smallest hash.  An empty bin copies from a full one, found by a walk of its own over the bins
(optimal densification; the walk of a bin is an odd step from a start, both drawn by hash, so it
meets every bin once).  Four bits of every bin, from the low part of its hash, are
packed into 64-bit numbers.  Bins of two
fingerprints that agree by chance, one in sixteen, are taken off the likeness.

Defined cases: a null text is read as empty; a text of one to four words is one shingle; a text
without words has the fingerprint of zeros, is like (1) another of the kind and unlike (0) any other;
equal texts have equal fingerprints; rows of equal ids follow each other by a digest of their text;
a row without an id comes first; of one document alone, the next document is itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import staged

BINS, BITS, SHINGLE_WORDS = 256, 4, 5
PER_LONG = 64 // BITS
LOW = 63 - (BINS.bit_length() - 1)
#: Steps of a walk taken at once, and rounds of them between two looks at whether any bin is empty.
PROBES, TURNS = 4, 8
#: Documents of a range that one window looks along.
ROWS_PER_RANGE = 5_000
#: Most ranges whose first ids are broadcast (16 bytes each).
BROADCAST_ROWS = 100_000


def _mixed(number: int) -> int:
    """A fixed 32-bit mix, for the walks."""
    number = (number ^ number >> 16) * 0x45D9F3B & 0xFFFFFFFF
    number = (number ^ number >> 16) * 0x45D9F3B & 0xFFFFFFFF
    return number ^ number >> 16


def shingle_hashes(text: Column) -> Column:
    """Hashes of the shingles as numbers of 63 bits."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def at(all_words: Column) -> Column:
        last = F.size(all_words) - SHINGLE_WORDS
        whole = F.array(F.shiftrightunsigned(F.xxhash64(all_words), 1))
        return F.when(F.size(all_words) == 0, F.array().cast("array<bigint>")).when(last < 0, whole).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(
                F.xxhash64(*[F.get(all_words, i + k) for k in range(SHINGLE_WORDS)]), 1)))

    # an array of one element binds the words once
    return F.get(F.transform(F.array(words), at), 0)


def bins(hashes: Column) -> Column:
    """Smallest hash of each bin in order of bins; the largest number of its range where a bin is empty."""
    marks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")),
                        lambda b: F.shiftleft(b, LOW) + F.lit((1 << LOW) - 1).cast("bigint"))
    ordered = F.sort_array(F.concat(hashes, marks))
    return F.get(F.transform(F.array(ordered), lambda o: F.filter(
        o, lambda h, i: (i == 0) | (F.shiftright(h, LOW) != F.shiftright(F.get(o, i - 1), LOW)))), 0)


def densified(smallest: Column) -> Column:
    """Low 31 bits of each bin's hash; an empty bin takes those of the first full bin on its walk."""
    low = F.lit((1 << LOW) - 1).cast("bigint")
    values = F.transform(smallest, lambda h: F.when(
        h.bitwiseAND(low) != low, h.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).cast("int")))
    starts = F.array(*[F.lit(_mixed(b + 1) % BINS) for b in range(BINS)])
    steps = F.array(*[F.lit(_mixed(b + 0x10001) % BINS | 1) for b in range(BINS)])

    def has_empty(now: Column) -> Column:
        return F.exists(now, lambda v: v.isNull())

    def filled(full: Column) -> Column:
        def walk(now: Column, turn: Column) -> Column:
            def at(b: Column, k: int) -> Column:
                return F.get(full, (F.get(starts, b) + F.get(steps, b) * (turn * PROBES + k)).bitwiseAND(F.lit(BINS - 1)))

            return F.transform(now, lambda v, b: F.coalesce(v, *[at(b, k) for k in range(PROBES)]))

        def some(now: Column, group: Column) -> Column:
            turns = F.sequence(F.lit(0), F.lit(TURNS - 1))
            return F.aggregate(turns, now, lambda n, t: F.when(has_empty(n), walk(n, group * TURNS + t)).otherwise(n))

        groups = F.sequence(F.lit(0), F.lit(BINS // (PROBES * TURNS) - 1))
        all_of_it = F.aggregate(groups, full, lambda n, g: F.when(has_empty(n), some(n, g)).otherwise(n))
        return F.when(has_empty(full), all_of_it).otherwise(full)

    return F.get(F.transform(F.array(values), filled), 0)


def packed(values: Column) -> Column:
    """Four bits for each bin, sixteen bins to a number.

    A bin takes its bits by a multiplier of its own, so that copies of one hash in two unlike
    fingerprints agree by chance bin by bin, not all at once.
    """
    factors = F.array(*[F.lit(_mixed(b + 0x20001) & 0x7FFFFFFF | 1).cast("bigint") for b in range(BINS)])
    low_bits = F.transform(values, lambda v, b: F.shiftright(v.cast("bigint") * F.get(factors, b), 31 - BITS).bitwiseAND(
        F.lit((1 << BITS) - 1).cast("bigint")))

    def pack(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda g: F.aggregate(
            F.slice(values, g * PER_LONG + 1, F.lit(PER_LONG)), F.lit(0).cast("bigint"),
            lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v)))

    return F.get(F.transform(F.array(low_bits), pack), 0)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint (array of 64-bit numbers, empty for a text without words) of a text column."""
    hashes = F.array(shingle_hashes(F.coalesce(text.cast("string"), F.lit(""))))
    return F.get(F.transform(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
        packed(densified(bins(h))))), 0)


def as_hex(mark: Column) -> Column:
    numbers = F.concat_ws("", F.transform(mark, lambda n: F.lower(F.lpad(F.hex(n), 16, "0"))))
    return F.when(F.size(mark) == 0, F.lit("0" * (BINS * BITS // 4))).otherwise(numbers)


def likeness(one: Column, two: Column) -> Column:
    """Share of shingles in common, from 0 to 1, without the bins that agree by chance."""
    def differing(x: Column) -> Column:
        spread = reduce(lambda a, k: a.bitwiseOR(F.shiftrightunsigned(x, k)), range(1, BITS), x)
        return F.bit_count(spread.bitwiseAND(F.lit(0x1111111111111111)))

    apart = F.aggregate(F.zip_with(one, two, lambda a, b: a.bitwiseXOR(b)), F.lit(0), lambda n, x: n + differing(x))
    chance = 1.0 / (1 << BITS)
    share = ((F.lit(float(BINS)) - apart) / BINS - chance) / (1 - chance)
    empty = (F.size(one) == 0) | (F.size(two) == 0)
    return F.when(empty, ((F.size(one) == 0) & (F.size(two) == 0)).cast("double")).otherwise(F.greatest(F.lit(0.0), share))


def barrier(df: DataFrame) -> DataFrame:
    """Keep computed columns from being put again into each expression that uses them."""
    names = df.columns
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in names]))).alias("_row")).select(
        *[F.col("_row").getField(c).alias(c) for c in names])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every document."""
    return docs.select(F.col(f"`{key}`"), fingerprint(F.col(f"`{text}`")).alias("fingerprint"))


def _ranges(docs: DataFrame) -> Column:
    """Ordered range number of an id: even slices between approximate percentiles; 0 for no id."""
    facts = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                     F.percentile_approx("doc_id", [i / 16 for i in range(1, 16)], 1000).alias("cuts")).first()
    out = F.lit(0).cast("bigint")
    if not facts["n"]:
        return out
    cuts = sorted({facts["low"], *facts["cuts"], facts["high"] + 1})
    slices = max(1, -(-facts["n"] // (ROWS_PER_RANGE * 16)))
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        width = max(1, -(-(high - low) // slices))
        place = F.floor((F.col("doc_id") - low) / width).cast("bigint") + 1 + number * slices
        out = F.when(F.col("doc_id") >= low, place).otherwise(out)
    return out


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Documents (doc_id a whole number, text, ...) and ``next``: the carried columns of the next document by id, cyclically.

    Windows look along ranges of ids.  The first document of a range is also put at the end of the
    range before it (of the last one, for the first), so no window needs a second range.
    """
    ranged = docs.withColumn("_range", _ranges(docs))
    around = Window.orderBy("_range")  # one row for each range
    firsts = staged(ranged.select("_range", "doc_id").groupBy("_range").agg(F.min("doc_id").alias("_first")), "ranges")
    hosts = firsts.withColumn("_host", F.lag("_range").over(around)).crossJoin(firsts.agg(F.max("_range").alias("_last"))).select(
        "_first", F.coalesce("_host", "_last").alias("_host"))
    if firsts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    guests = docs.join(hosts, F.col("doc_id").eqNullSafe(F.col("_first"))).select(
        *docs.columns, F.col("_host").alias("_range"), F.lit(1).alias("_guest"))
    every = ranged.withColumn("_guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return every.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter("_guest = 0").drop("_guest", "_range")


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Edited: the last quarter of the characters gives way to as many from the start of the next document.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = barrier(docs.select(F.col("doc_id"), body.alias("text"), F.length(body).cast("bigint").alias("n_chars"), fingerprint(body).alias("mark")))
    near = with_next(marked, ["text", "mark"])
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    edited = barrier(near.select("doc_id", "n_chars", "mark", F.col("next.mark").alias("next_mark"),
                                 F.concat(head, F.substring(F.col("next.text"), F.lit(1), quarter)).alias("edited")))
    both = barrier(edited.withColumn("edited_mark", fingerprint(F.col("edited"))))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("mark")).alias("fingerprint"),
        as_hex(F.col("edited_mark")).alias("edited_fingerprint"), likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"))
