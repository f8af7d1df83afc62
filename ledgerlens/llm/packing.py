"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Pieces are dealt evenly to bins of work, each packed by best-fit decreasing.  Dual
feasible functions bound the number of sequences from below, for each partition and
for the whole table.  Partitions whose count is above their bound, and the part-filled
sequences of all partitions while the total is above the total bound, exchange their
documents: those sequences are opened, mixed and packed again.

Defined cases: a null or empty text is its end mark alone; repeated rows are packed
like any other rows; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import Any

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import by_size, staged, worker_cache, worker_imports

CAPACITY = 4096
#: Pieces packed by one task.
PIECES_PER_TASK = 20_000
#: Code points of the texts that are encoded together.
BATCH_CHARS = 4_000_000
#: Units that a worker remembers between batches.
KNOWN_WORDS = 600_000
#: ASCII characters that are no letter, digit or white space.
MARKS = string.punctuation


class WordEncoder:
    """Ids of texts, word by word.

    The tokenizer never joins characters across ASCII white space, so a text's ids are those
    of its words one after the other.  Arrow splits texts and finds the different forms of their
    words, and the units of these forms: letters, and the marks after them.  Only units are looked
    up; those that no text has held for longest leave.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        # a token of letters that is found in texts as they are would lose its capitals
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.folds = _folds(self.tokenizer.normalizer) and not any(t.content.isalpha() for t in added)
        self.bare = None
        if self.folds:  # small ASCII letters are normalized already
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
        self.cut: dict[str, bool] = {}
        self.known: dict[bytes, int] = {}
        # the ids of all known units one after the other; how many each has, and the last batch that held it
        self.ids, self.sizes, self.held = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.batch = 0

    def _apart(self, letter: str) -> bool:
        """Whether the tokenizer cuts marks off from the letter before them, as it normalizes it (a dotted I ends in no letter)."""
        if letter not in self.cut:
            rules, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            text = rules.normalize_str(letter + MARKS) if rules else letter + MARKS
            parts = splitter.pre_tokenize_str(text) if splitter else []
            self.cut[letter] = text.endswith(MARKS) and len(parts) > 1 and parts[-1][1] == (len(text) - len(MARKS), len(text))
        return self.cut[letter]

    def _units(self, forms: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The different units of word forms, and the two of each form: letters and the marks after them, or the form and nothing."""
        stems = pc.ascii_rtrim(forms, MARKS)
        sizes, stem_sizes = (pc.binary_length(x).to_numpy() for x in (forms, stems))
        letters = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        apart = np.array([len(x) == 1 and self._apart(x) for x in last.dictionary.to_pylist()], bool)
        alone = letters & ((sizes == stem_sizes) | apart[last.indices.to_numpy()])
        if self.folds:
            # no letter composes with an ASCII letter before it, so these can be made small first
            forms = pc.if_else(pa.array(alone), pc.ascii_lower(forms), forms)
        # heads and tails are slices of the forms, which lie one after the other
        cuts = np.zeros(2 * len(forms) + 1, np.int64)
        cuts[2::2] = np.cumsum(sizes)
        cuts[1::2] = cuts[:-1:2] + np.where(alone, stem_sizes, sizes)
        data = forms.cast(pa.large_binary()).buffers()[2] or pa.py_buffer(b"")
        parts = pa.Array.from_buffers(pa.large_binary(), 2 * len(forms), [None, pa.py_buffer(cuts), data]).dictionary_encode()
        return parts.dictionary.cast(pa.large_string()), parts.indices.to_numpy().reshape(-1, 2)

    def _learn(self, units: pa.Array) -> None:
        letters = pc.utf8_is_alpha(units)
        small = pc.and_(letters, pc.match_substring_regex(units, "^[a-z]+$")) if self.folds else pa.array(np.zeros(len(units), bool))
        rest = units.filter(pc.invert(letters)).to_pylist()
        # words of letters only are one unit of the tokenizer, which a mark ends: encode them together
        for tokenizer, chosen in ((self.bare, small), (self.tokenizer, pc.and_not(letters, small))):
            words = units.filter(chosen).to_numpy(zero_copy_only=False).tolist()
            new = []
            for at in range(0, len(words), 500):
                part = words[at:at + 500]
                ids = np.array(_ids(tokenizer, [" ".join(part)])[0], "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part):
                    new.append((part, ids, np.diff(cuts, prepend=0)))
                else:
                    rest.extend(part)
            self._keep(new)
        new = []
        for at in range(0, len(rest), 2000):
            part = rest[at:at + 2000]
            found = _ids(self.tokenizer, part)
            new.append((part, np.array(list(chain.from_iterable(found)), "<u4"), np.array(list(map(len, found)), np.int64)))
        self._keep(new)

    def _keep(self, new: list[tuple[list[str], np.ndarray, np.ndarray]]) -> None:
        """Note lists of units, their ids and how many each has."""
        units = [unit.encode() for part, _, _ in new for unit in part]
        self.known.update(zip(units, range(len(self.sizes), len(self.sizes) + len(units))))
        self.ids = np.concatenate([self.ids, *(ids for _, ids, _ in new)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, _, sizes in new)])
        self.held = np.concatenate([self.held, np.full(len(units), self.batch)])

    def _forget(self) -> None:
        """Keep at most half of the units, those that were held last."""
        order = np.argsort(self.held, kind="stable")
        stay = np.zeros(len(order), bool)
        stay[order[max(0, len(order) - KNOWN_WORDS // 2):]] = True
        units = sorted((at, unit) for unit, at in self.known.items() if stay[at])
        at = np.array([at for at, _ in units], np.int64)
        self.known = {unit: new for new, (_, unit) in enumerate(units)}
        self.ids, self.sizes = _picked(self.ids, self.sizes, at)
        self.held = self.held[at]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.sizes) > KNOWN_WORDS:
            self._forget()
        self.batch += 1
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.flatten().dictionary_encode()
        parts, of_forms = self._units(words.dictionary)
        units = parts.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, units))
        new = [at is None for at in found]
        if any(new):
            self._learn(parts.filter(pa.array(new)))
            found = [self.known[unit] if at is None else at for unit, at in zip(units, found)]
        at = np.array(found, np.int64)
        self.held[at] = self.batch
        ids, sizes = _picked(self.ids, self.sizes, at[of_forms.ravel()])
        ids, sizes = _picked(ids, sizes.reshape(-1, 2).sum(axis=1), words.indices.to_numpy())
        data = ids.tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        return [data[a:b] for a, b in pairwise(ends.tolist())]


def _folds(rules: Any) -> bool:
    """Whether a normalizer lower-cases and does nothing else but NFC and one blank for white space."""
    if rules is None:
        return False
    own = json.loads(rules.__getstate__())
    steps = own["normalizers"] if own["type"] == "Sequence" else [own]
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    return {"type": "Lowercase"} in steps and all(s in ({"type": "NFC"}, {"type": "Lowercase"}, blank) for s in steps)


def _ids(tokenizer: Any, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _picked(ids: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, as ``sizes`` cuts them, in the order of ``picks``, and the sizes of these."""
    starts, chosen = np.cumsum(sizes) - sizes, sizes[picks]
    ends = np.cumsum(chosen)
    return ids[np.repeat(starts[picks] - ends + chosen, chosen) + np.arange(chosen.sum())], chosen


def encoder(path: str) -> WordEncoder:
    return worker_cache(f"word encoder {path}", lambda: WordEncoder(path))


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces: key, piece, start, length, ids_crc32 and, on request, the ids themselves."""
    worker_imports(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    kind = dict(docs.dtypes)[key]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            for first, texts in by_size(batch["text"].fillna(""), BATCH_CHARS):
                rows = []
                for index, ids in enumerate(encode(texts), first):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((index, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                out = pd.DataFrame(rows, columns=["index", "piece", "start", "length", "ids_crc32", "ids"])
                out.insert(0, "key", batch["key"].iloc[out.pop("index")].array)
                if with_ids:
                    out["ids"] = [np.frombuffer(i, "<u4").astype(np.int32) for i in out["ids"]]
                    yield out
                else:
                    yield out.drop(columns="ids")

    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInPandas(pieces, schema).withColumnRenamed("key", key)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; ties keep the order of the items.

    Open bins hang in stacks by the room they have; a bit set of the rooms in use finds the
    tightest one that still takes an item.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            stack = stacks[room]
            chosen = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            chosen, room = len(fills), capacity
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += length
        room -= length
        if room:
            if not stacks[room]:
                rooms |= 1 << room
            stacks[room].append(chosen)
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest sequences for ``counts[length]`` pieces, as dual feasible functions prove it.

    Two families (Fekete and Schepers): thresholds eps, which count items above capacity - eps
    whole and drop items below eps, and the stepped functions u_k; both hold for any packing.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    number = counts[sizes].astype(object)
    best = -(-int((sizes * number).sum()) // capacity)
    whole = sizes.astype(np.int64)
    weight = counts[sizes].astype(np.float64)
    for eps in np.unique(np.concatenate([whole[whole <= capacity // 2], [capacity // 2]])):
        big, mid = whole > capacity - eps, (whole >= eps) & (whole <= capacity - eps)
        total = int(weight[big].sum()) * capacity + int((whole[mid] * weight[mid]).sum())
        best = max(best, -(-total // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * whole
        exact = scaled % capacity == 0
        units = np.where(exact, whole * k, scaled // capacity * capacity)  # in k-ths of the capacity
        total = int((units * weight).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def _packed(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Pack each partition; every row learns its sequence, its fill and the partition's count and bound."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        part = TaskContext.get().partitionId()
        rows["sequence_id"] = bins + (part << 24) + (turn << 48)
        rows["offset"], rows["_fill"] = offsets, fills[bins]
        rows["_gap"] = len(fills) - bound
        yield rows

    plain = [c for c in rows.columns if c not in ("sequence_id", "offset", "_fill", "_gap")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*plain).schema.fields)
    return rows.select(*plain).mapInPandas(pack, f"{fields}, sequence_id bigint, offset bigint, _fill bigint, _gap bigint")


def _sequences(rows: DataFrame) -> int:
    """Each sequence has one piece at offset 0."""
    return rows.filter(F.col("offset") == 0).count()


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Give each row of ``pieces`` (any columns, with a length of 1 to ``capacity``) a sequence_id and an offset.

    Rounds open the sequences that are likely to be improved, so what moves shrinks from round to
    round.  A round that saves nothing is discarded; from then on rounds open all part-filled
    sequences, and the next one that saves nothing ends the work.
    """
    spark = pieces.sparkSession
    worker_imports(spark)
    pieces = staged(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, number in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = number
    bound = lower_bound(counts, capacity)
    tasks = max(1, -(-int(counts.sum()) // pieces_per_task))
    current = staged(_packed(pieces.repartition(tasks), capacity, 0), "packed")
    done: list[DataFrame] = []
    total = _sequences(current)
    # part-filled sequences, and whole partitions that are not at their bound, exchange documents
    likely = (F.col("_fill") < capacity) & ((F.col("_gap") > 0) | (F.col("_fill") <= capacity - capacity // 64))
    loose, wide, turn = likely, False, 0
    while total > bound:
        opened = current.filter(loose)
        before, rows = opened.agg(F.coalesce(F.sum((F.col("offset") == 0).cast("bigint")), F.lit(0)), F.count(F.lit(1))).first()
        after = before
        if before >= 2:
            turn += 1
            again = staged(_packed(opened.repartition(max(1, -(-rows // pieces_per_task))), capacity, turn), "packed")
            after = _sequences(again)
        if after < before:
            done.append(current.filter(~loose))
            current, total = again, total - before + after
        elif wide:
            break
        else:
            loose, wide = F.col("_fill") < capacity, True
            for part in done:
                current = current.unionByName(part)
            done = []
    for part in done:
        current = current.unionByName(part)
    return current.drop("_fill", "_gap")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1,
                   pieces_per_task: int = PIECES_PER_TASK, with_ids: bool = False) -> DataFrame:
    """Tokenize documents, cut those longer than a sequence, and pack the pieces."""
    return pack(tokenized_pieces(docs, tokenizer, end_id, capacity, with_ids), capacity, pieces_per_task)
