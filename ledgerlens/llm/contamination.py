"""Benchmark decontamination with an Aho-Corasick automaton over normalised test questions and answers.

Texts are lower-cased in A-Z and split into words at every other ASCII character that is no letter or
digit.  A window is ten consecutive words of an item; an item of fewer words is one window.  The automaton
holds the items in blocks of five words from their start on, and short items whole: any ten words in a row
cover one such block, so the automaton is about as large as the benchmark and not ten times as large.
Each text is streamed through it once; around a located block, the up to five windows that can hold it are
looked up by their words.  Hit words become code point spans of the original text.

One automaton serves a benchmark of up to ``shard_chars`` normalised characters: its text, measured first,
is sent to the workers, and documents do not move.  Larger benchmarks are dealt to several automata by a
hash of the item, sent one after the other; finds of one document are united by its id and text.

Defined cases: a null or empty text, or one without words, has no words and is clean; an item without words
has no window; rows of an item count as one, and equal rows once; an item whose id is null taints words but
is not listed; repeated documents are judged alike; an empty benchmark finds nothing and an empty table
gives an empty result; other columns are kept, but for one that has the result's name, which is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import by_size, free_names, staged, worker_cache, worker_imports

WINDOW = 10
#: Normalised characters of the items of one automaton.
SHARD_CHARS = 2_000_000
#: Words of an item that stay together when it is dealt; the next part repeats its last windows.
SEGMENT_WORDS = 5_000
#: Bytes that one step of the automaton reads.
STEP = 1_000_000
#: Upper to lower case, and blanks for the ASCII characters that part words: a byte for a byte, so places stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Screen:
    """An automaton over parts of items, and the windows its finds may stand for."""

    def __init__(self, segments: Sequence[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.block = window, (window + 1) // 2
        self.items: list[str] = []
        self.windows: dict[bytes, list[int]] = {}
        names: dict[str, int] = {}
        blocks: dict[bytes, int] = {}  # words of a pattern; negative once it is a short item and a block
        shorts: set[bytes] = set()
        for item, line in segments:
            words = line.split()
            number = -1
            if item is not None:
                number = names.setdefault(item, len(names))
            last = len(words) - window
            for at in range(max(last + 1, 1)):
                owners = self.windows.setdefault(b" ".join(words[at:at + window]), [])
                if number not in owners[-1:]:
                    owners.append(number)
            if last < 0:
                shorts.add(line)
                blocks.setdefault(line, len(words))
            for at in range(0, len(words) - self.block + 1 if last >= 0 else 0, self.block):
                blocks[b" ".join(words[at:at + self.block])] = self.block
        self.items = list(names)
        self.automaton = ahocorasick.Automaton()
        for line, size in blocks.items():
            is_short = line in shorts
            self.automaton.add_word(f" {line.decode('latin-1')} ", (size, is_short, not is_short or size == self.block))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """Merged ranges of hit words as first, past, first, past, ...; and the items, unordered."""
        if not len(self.automaton) or not words:
            return [], []
        line = b" %b " % b" ".join(words)
        steps = self.automaton.iter("")
        found = []
        for at in range(0, len(line), STEP):
            steps.set(line[at:at + STEP].decode("latin-1"))
            found += steps
        if not found:
            return [], []
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        past = np.searchsorted(stops, [end for end, _ in found]) + 1
        starts, hits, owners = set(), [], set()
        for end, (_, (size, is_short, is_block)) in zip(past.tolist(), found):
            if is_short:
                hits.append((end - size, end))
                owners.update(self.windows[b" ".join(words[end - size:end])])
            if is_block:
                starts.update(range(max(end - 2 * size + 1, 0), end - size + 1))
        for at in starts:
            told = self.windows.get(b" ".join(words[at:at + self.window])) if at + self.window <= len(words) else None
            if told:
                hits.append((at, at + self.window))
                owners.update(told)
        owners.discard(-1)
        return merged(hits), [self.items[i] for i in owners]


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Ranges that overlap or touch become one."""
    out: list[int] = []
    for first, past in sorted(ranges):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], past)
        else:
            out += [first, past]
    return out


def spans(text: str, ranges: list[int]) -> list[tuple[int, int]]:
    """Code point ranges of the original text for ranges of words."""
    if not ranges:
        return []
    raw = text.encode()
    inside = np.concatenate([[False], np.frombuffer(raw.translate(FOLD), np.uint8) != 32, [False]])
    begins = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[begins[a]]), int(points[ends[b - 1]])) for a, b in zip(ranges[::2], ranges[1::2])]


FACTS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint, past:bigint>>"


def facts(text: str | None, words: list[bytes], ranges: list[int], items: list[str]) -> tuple:
    return len(words), sum(ranges[1::2]) - sum(ranges[::2]), sorted(items), spans(text or "", ranges)


def segments(benchmark: DataFrame, item: str, fields: Sequence[str], window: int) -> DataFrame:
    """Distinct normalised parts of the items' fields: item (as text), line and its size."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = SEGMENT_WORDS - window + 1
        for batch in batches:
            for first, texts in by_size(batch["text"]):
                rows = [(index, b" ".join(words[at:at + SEGMENT_WORDS]))
                        for index, text in enumerate(texts, first) if (words := words_of(text))
                        for at in range(0, max(len(words) - window + 1, 1), step)]
                out = pd.DataFrame(rows, columns=["index", "line"])
                out.insert(0, "item", batch["item"].iloc[out.pop("index")].array)
                yield out

    slim = None
    for field in fields:
        part = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{field}`").cast("string").alias("text")).filter("text is not null")
        slim = part if slim is None else slim.unionByName(part)
    return slim.mapInPandas(cut, "item string, line binary").distinct().withColumn("size", F.octet_length("line") + 1)


def find(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", fields: Sequence[str] = ("text",), text: str = "text", doc_id: str = "doc_id",
         window: int = WINDOW, shard_chars: int = SHARD_CHARS, into: str = "contamination") -> DataFrame:
    """Documents with a struct of n_words, n_hit, items (sorted as strings) and spans (code points, merged) in ``into``."""
    spark = docs.sparkSession
    worker_imports(spark)
    parts = staged(segments(benchmark, item, fields, window), "items")
    chars = parts.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    body = F.col(f"`{text}`").cast("string")

    def sent(shard: int):
        """The parts of one shard, of about ``shard_chars`` at most, to every worker."""
        own = parts if shards == 1 else parts.filter(F.pmod(F.xxhash64("item", "line"), F.lit(shards)) == shard)
        name, rows = uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item, bytes(r.line)) for r in own.select("item", "line").collect()])
        return rows, lambda: worker_cache(f"benchmark {name}", lambda: Screen(rows.value, window))

    if shards == 1:
        _, screen = sent(0)

        @F.pandas_udf(FACTS)
        def judged(texts: pd.Series) -> pd.DataFrame:
            own, rows = screen(), []
            for _, some in by_size(texts.fillna("")):
                for t in some:
                    words = words_of(t)
                    rows.append(facts(t, words, *own.scan(words)))
            return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

        return docs.select(*kept, judged(body).alias(into))

    mark, key, told = free_names(docs.columns, "_mark", "_key", "_told")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("k"), F.xxhash64(body).alias("m"), body.alias("t"))
    passes = None
    for shard in range(shards):
        rows, screen = sent(shard)

        @F.pandas_udf("ranges array<bigint>, items array<string>")
        def located(texts: pd.Series) -> pd.DataFrame:
            own = screen()
            return pd.DataFrame([own.scan(words_of(t)) for _, some in by_size(texts.fillna("")) for t in some], columns=["ranges", "items"])

        found = staged(keyed.select("k", "m", located("t").alias("f")).filter("size(f.ranges) > 0").groupBy("k", "m").agg(F.first("f").alias("f")), "finds")
        passes = found if passes is None else passes.unionByName(found)
        rows.destroy()
    united = passes.groupBy("k", "m").agg(F.struct(
        F.flatten(F.collect_list("f.ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("f.items"))).alias("items")).alias(told)).select(
        F.col("k").alias(key), F.col("m").alias(mark), told)

    @F.pandas_udf(FACTS)
    def joined(texts: pd.Series, ranges: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own, names in zip(texts, ranges, items):
            own = [] if own is None else merged(list(zip(own[::2].tolist(), own[1::2].tolist())))
            rows.append(facts(t, words_of(t), own, [] if names is None else list(names)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    pairs = docs.join(united, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)) & (F.xxhash64(body) == F.col(mark)), "left")
    return pairs.select(*kept, joined(body, F.col(f"{told}.ranges"), F.col(f"{told}.items")).alias(into))


def clean(docs: DataFrame, benchmark: DataFrame, least_share: float | None = None, text: str = "text", **options) -> DataFrame:
    """Documents less their hit spans; or, with ``least_share``, without those whose share of hit words reaches it.

    Columns stay as they are but for the text.  A span goes with what stands between its words, nothing around it.
    """
    (into,) = free_names(docs.columns, "_found")
    found = find(docs, benchmark, text=text, into=into, **options)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if least_share is not None:
        return found.filter(~((F.col(f"{into}.n_hit") > 0) & (F.col(f"{into}.n_hit") >= least_share * F.col(f"{into}.n_words")))).select(*names)
    at = F.col(f"{into}.spans")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(at, lambda s: s["past"]))
    ends = F.concat(F.transform(at, lambda s: s["first"]), F.array(F.length(F.col(f"`{text}`")).cast("bigint")))
    body = F.col(f"`{text}`")
    left = F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")),
                                    lambda z: F.substring(body, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int"))), "")
    return found.select(*[F.when(F.size(at) > 0, left).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


