"""Removal of repeated passages by repeated-phrase automata.

A window is 50 consecutive words of one document.  Of a window's 43 phrases of eight words, the one
with the smallest hash (the leftmost of equals) is its anchor, so equal windows have equal anchors at
equal places, and the windows of one anchor follow each other.

1. Anchors of all windows are counted by their words; an anchor that starts in two documents recurs.
2. Documents are dealt to shards.  A shard's recurring phrases are compiled into one Aho-Corasick
   automaton, and all its documents are streamed through it: every occurrence is located.
3. Around a located anchor, the words that its windows cover are a context.  Equal contexts are one
   class, owned by its smallest document; in every other document all these windows are repeats.
   Classes that share an anchor are compared window by window, for their owners only.
4. Covered words are removed, from the input's windows and not from what is left of them.

Hot phrases and groups of copies are aggregated before they move; nothing gathers a group, and an
automaton holds the phrases of one shard.

Defined cases: a null text has no words; a document under 50 words has no window; rows without an
id lose nothing and cause no removal; repeated rows (equal ids) do not remove from each other; an
empty table gives an empty result; other columns are kept by ``without_repeats`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import by_size, free_names, staged, worker_imports

WINDOW, PHRASE = 50, 8
#: Characters of text in a shard of documents.
SHARD_CHARS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def phrase_hashes(hashes: np.ndarray) -> np.ndarray:
    """A mixed hash of the phrase at each word."""
    size = len(hashes) - PHRASE + 1
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(PHRASE):
            out = out * BASE + hashes[step:step + size]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def leftmost_minimum(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the first minimum of each ``span`` consecutive values, by doubling."""
    low, at, reach = values, np.arange(len(values)), 1
    while reach < span:
        step = min(reach, span - reach)
        size = len(low) - step
        right = low[step:] < low[:size]
        low = np.where(right, low[step:], low[:size])
        at = np.where(right, at[step:], at[:size])
        reach += step
    return at


def anchors(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index of each anchor, and the first window and number of windows it stands for."""
    at = leftmost_minimum(phrases, WINDOW - PHRASE + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.diff(np.append(first, len(at)))


def window_hashes(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)])
        return (sums[WINDOW:] - sums[:-WINDOW]) * powers(INVERSE, len(hashes))[:len(hashes) - WINDOW + 1]


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's distinct anchors: hash, words, shard and document."""
    for batch in batches:
        ids, shards = batch["doc_id"].to_numpy(), batch["shard"].to_numpy()
        for first, texts in by_size(batch["text"]):
            marks, names, owner = [], [], []
            for index, text in enumerate(texts, first):
                words = text.encode().split()
                if len(words) < WINDOW:
                    continue
                phrases = phrase_hashes(word_hashes(words))
                places = anchors(phrases)[0]
                own, where = np.unique(phrases[places], return_index=True)
                marks.append(own)
                names += [b" ".join(words[p:p + PHRASE]).decode() for p in places[where].tolist()]
                owner.append(np.full(len(own), index))
            if marks:
                rows = np.concatenate(owner)
                yield pd.DataFrame({"h": np.concatenate(marks).view(np.int64), "phrase": names, "shard": shards[rows], "doc_id": ids[rows]})


class Located:
    """The segments of documents around the phrases of one shard's automaton."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()

    def add(self, phrases: list[str]) -> None:
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", len(phrase) + 2)

    def segments(self, text: str) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
        """Anchor hash, context digest (two numbers), first window, number of windows, hashes of the windows."""
        if not len(self.automaton):
            return
        if self.automaton.kind != ahocorasick.AHOCORASICK:
            self.automaton.make_automaton()
        words = text.encode().split()
        if len(words) < WINDOW:
            return
        line = f" {b' '.join(words).decode()} "
        ends = [(end, size) for end, size in self.automaton.iter(line)]
        if not ends:
            return
        starts = np.cumsum(np.fromiter(map(len, line[1:-1].split(" ")), np.int64, len(words)) + 1)
        places = np.searchsorted(starts, [end - size + 1 for end, size in ends], side="right")
        located = np.zeros(len(words) + 1, bool)
        located[places] = True
        hashes = word_hashes(words)
        phrases = phrase_hashes(hashes)
        windows = window_hashes(hashes).view(np.int64)
        for place, first, number in zip(*(a.tolist() for a in anchors(phrases))):
            if located[place]:
                context = b" ".join(words[first:first + number - 1 + WINDOW])
                digest = xxhash.xxh3_128_digest(context + b" %d %d" % (place - first, number))
                low, high = np.frombuffer(digest, "<i8").tolist()
                yield int(phrases[place:place + 1].view(np.int64)[0]), low, high, first, number, windows[first:first + number]


def _located_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard with its phrases (kind 0) first, then its documents, to segments."""
    shard, located = None, Located()
    names = ["h", "c1", "c2", "first", "number", "windows"]
    for batch in batches:
        rows, owner = [], []
        for (number, kind), part in batch.groupby(["shard", "kind"], sort=True):
            if number != shard:
                shard, located = number, Located()
            if kind == 0:
                located.add(part["text"].tolist())
                continue
            for index, text in zip(part.index.tolist(), part["text"].tolist()):
                found = list(located.segments(text))
                rows += found
                owner += [index] * len(found)
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, "mark", batch["mark"].loc[owner].array)
        out.insert(0, "doc_id", batch["doc_id"].loc[owner].array)
        yield out


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, mark (XXH64 of the text) and ``starts``: an array of first window * 64 + number of windows that repeat."""
    worker_imports(docs.sparkSession)
    body = F.col("text").cast("string")
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.xxhash64(body).alias("mark"), body.alias("text")).filter("doc_id is not null and text is not null")
    chars = docs.agg(F.sum(F.length(body)).alias("n")).first()["n"] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    # equal rows go by where they come from, so that no shard takes all of them
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "mark", F.spark_partition_id()), F.lit(shards)).cast("int"))

    every = staged(dealt.select("doc_id", "shard", "text").mapInPandas(_anchor_rows, f"h bigint, phrase string, shard int, doc_id {kind}"), "anchors")
    recurring = staged(every.groupBy("h", "phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                       .filter("low < high").select("h", "phrase"), "phrases")
    needed = every.select("h", "shard").distinct().join(recurring, "h").select("shard", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"),
                                                                              F.lit(0).cast("bigint").alias("mark"), F.col("phrase").alias("text"))
    stream = needed.unionByName(dealt.withColumn("kind", F.lit(1))).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    segments = staged(stream.mapInPandas(
        _located_rows, f"doc_id {kind}, mark bigint, h bigint, c1 bigint, c2 bigint, first int, number int, windows array<bigint>"), "segments")

    context = ["h", "c1", "c2"]
    owners = staged(segments.groupBy(*context).agg(F.min("doc_id").alias("owner")), "owners")
    placed = segments.select(*context, "doc_id", "mark", "first", "number").join(owners, context)
    whole = placed.filter("doc_id > owner").select("doc_id", "mark", (F.col("first").cast("bigint") * 64 + F.col("number")).alias("start"))
    several = owners.groupBy("h").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low < high").select("h")
    # only owners' windows are looked at: a context and its owner are one row of each side, however many copies there are
    classes = owners.join(several, "h").withColumnRenamed("owner", "doc_id")
    opened = staged(segments.join(classes, [*context, "doc_id"]).select(
        "h", "doc_id", "mark", "first", F.posexplode("windows").alias("step", "window")), "windows")
    shared = opened.groupBy("h", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    single = opened.join(shared, ["h", "window"]).filter("doc_id > low").select(
        "doc_id", "mark", ((F.col("first") + F.col("step")).cast("bigint") * 64 + 1).alias("start"))
    return whole.unionByName(single).groupBy("doc_id", "mark").agg(F.collect_set("start").alias("starts"))


def cut(text: str | None, starts: np.ndarray | None) -> tuple[int, int, str]:
    """Number of words, number removed, and the kept words joined by one space."""
    words = (text or "").encode().split()
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words).decode()
    firsts, numbers = np.asarray(starts, np.int64) >> 6, np.asarray(starts, np.int64) & 63
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, firsts + numbers - 1 + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return len(words), int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist()) if not c]).decode()


def without_repeats(docs: DataFrame, into: str = "_kept") -> DataFrame:
    """Documents with all their columns (but one named as the result), and n_words, n_removed and kept_text in the struct column ``into``."""
    @F.pandas_udf("n_words bigint, n_removed bigint, kept_text string")
    def kept(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, s) for t, s in zip(texts, starts)], columns=["n_words", "n_removed", "kept_text"])

    key, mark, starts = free_names([*docs.columns, into], "_id", "_mark", "_starts")
    repeats = repeated_windows(docs).select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("starts").alias(starts))
    body = F.col("text").cast("string")
    joined = docs.join(repeats, (F.col("doc_id") == F.col(key)) & (F.xxhash64(body) == F.col(mark)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()], kept(body, F.col(starts)).alias(into))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Documents (with a text, and an n_chars column if there is one) without their repeated words; others stay as they are."""
    (into,) = free_names(docs.columns, "_kept")
    found = without_repeats(docs, into)
    changed = F.col(into)["n_removed"] > 0
    left = F.col(into)["kept_text"]
    new = {"text": F.when(changed, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(left).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
