"""Cross-tokenizer alignment by divide and conquer at shared cuts.

A text's bytes are covered by the tokens of a byte-level tokenizer (A) and of a SentencePiece model (B); a
shared cut is a place where a token of both ends.  An interval is cut at a common end near its middle, which
is sought outwards from the middle token of A by bisecting the ends of B; both halves go on alike, and an
interval without an inner cut is a leaf: one group.  Groups link the tokens whose byte ranges overlap.

Long texts are halved the same way before they are tokenized, at word borders near the middle: before a blank
or line end that follows no white space, and after a line end, tokens of both end in every text.  So a
recursion ends in words, a word form is tokenized and aligned once and remembered, and its groups hold in
every document.  Where a vocabulary has a piece over such a border, whole texts are aligned.

Corpus-wide counts of linked ids never meet documents one by one: documents are dealt to blocks of bounded
size, a block counts its distinct pairs once, and the counts of all blocks' pairs come back to each block, where
its documents' sums are read off by word form.  No table of all pairs is sent anywhere.

Defined cases: a text that is null, empty or that a tokenizer does not give back byte for byte (the blank
mark U+2581 is one such character for B) has no tokens and takes no part in the counts; repeated rows count
like others and have a row each; rows without an id are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.llm.common import by_size, staged, worker_cache, worker_imports

BLANK = "▁"
#: Characters of the documents of one block; a longer document is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of a part that is not halved further before it is cut into words.
PART_CHARS = 65_536
#: A pair of ids is one number.
KEEP = 1 << 32
#: Word forms that a worker remembers between blocks.
KNOWN_WORDS = 300_000
#: A place where both tokenizers cut: before a blank or line end after no white space, after a line end that is alone, and
#: between a Latin letter or digit and one of the marks that no piece of B has after one.
BORDER = r"(?<=\S)(?=[ \n])|(?<=\S\n)(?=\S)"
MARKS, LATIN = ".,!?;:", "0-9A-Za-zÀ-ÖØ-öø-ɏ"
#: Word forms that may be tokenized in one string with others: a blank at most, then no white space.
PLAIN = re.compile(r" ?\S+")


def common_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Numbers of tokens of A and B before the end of each group; both lists of ends rise to the same last end."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(ends_a), 0, len(ends_b))]
    while todo:
        low_a, high_a, low_b, high_b = todo.pop()
        if high_a - low_a == 1 or high_b - low_b == 1:  # one token has no inner cut
            out.append((high_a, high_b))
            continue
        # common ends before the last tokens of the interval, from the middle token of A outwards
        left = (low_a + high_a - 1) // 2
        right = left + 1
        cut = None
        while cut is None and (left >= low_a or right < high_a - 1):
            for at in (left, right):
                if low_a <= at < high_a - 1:
                    place = bisect_left(ends_b, ends_a[at], low_b, high_b - 1)
                    if place < high_b - 1 and ends_b[place] == ends_a[at]:
                        cut = (at + 1, place + 1)
                        break
            left, right = left - 1, right + 1
        if cut is None:
            out.append((high_a, high_b))
        else:
            todo += [(cut[0], high_a, cut[1], high_b), (low_a, cut[0], low_b, cut[1])]
    return out


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else None for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else None if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(BLANK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.line_end = self.b.encode("\n")
        with open(path_a) as file:
            split = json.load(file)["pre_tokenizer"]
        # word borders are cuts of both, if A splits at white space first and no piece of B goes over a border
        self.by_word = (split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
                        and not any(re.search(f"[^{BLANK}]{BLANK}", p) or "\n" in p and len(p) > 1 for p in pieces)
                        and [self.bytes_b[i] for i in self.line_end] == [b" ", b"\n"])
        marks = "".join(c for c in MARKS if not any(re.search(rf"[{LATIN}]{re.escape(c)}", p) for p in pieces))
        self.border = re.compile(BORDER + (rf"|(?<=[{LATIN}])(?=[{re.escape(marks)}])" if marks else ""))
        self.size_a, self.size_b = [[len(b or b"") for b in spoken] for spoken in (self.bytes_a, self.bytes_b)]
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.forget()

    def forget(self) -> None:
        """Word forms by number: group text, tokens of A and B, groups; and their pairs (a * KEEP + b).  Form 0 is what has no tokens."""
        self.known: dict[str, int] = {}
        self.texts: list[str] = [""]
        self.sizes: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.pairs: list[array] = [array("q")]

    def halves(self, text: str) -> Iterator[str]:
        """Parts of a text, cut at borders near the middle until they are short or have no border."""
        todo = [(0, len(text))]
        while todo:
            low, high = todo.pop()
            if high - low > PART_CHARS and self.by_word:
                middle = (low + high) // 2
                found = self.border.search(text, middle, high)
                cut = found.start() if found and found.start() < high else None
                if cut is None:
                    cut = max((m.start() for m in self.border.finditer(text, low + 1, middle)), default=None)
                if cut is not None:
                    todo += [(cut, high), (low, cut)]
                    continue
            yield text[low:high]

    def units(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        out: list[str] = []
        for part in self.halves(text):
            out += self.border.split(part)
        return out

    def remember(self, unit: str, ids_a: list[int], ids_b: list[int]) -> None:
        """Align a word form that both token lists give back, and number it."""
        names = self.names
        if len(ids_a) == 1 or len(ids_b) == 1:  # one token has no inner cut
            groups = [(len(ids_a), len(ids_b))]
            pairs = [a * KEEP + b for a in ids_a for b in ids_b]
        else:
            ends_a, ends_b = list(accumulate(map(self.size_a.__getitem__, ids_a))), list(accumulate(map(self.size_b.__getitem__, ids_b)))
            groups = common_groups(ends_a, ends_b)
            pairs, at_a, at_b, last = [], 0, 0, ends_a[-1]
            # the token that ends first gives way to the next of its kind, both at a common end
            while True:
                pairs.append(ids_a[at_a] * KEEP + ids_b[at_b])
                end_a, end_b = ends_a[at_a], ends_b[at_b]
                if end_a == end_b == last:
                    break
                at_a += end_a <= end_b
                at_b += end_b <= end_a
        text, from_a, from_b = [], 0, 0
        for past_a, past_b in groups:
            text.append(",".join([names[i] for i in ids_a[from_a:past_a]]) + "|" + ",".join([names[i] for i in ids_b[from_b:past_b]]))
            from_a, from_b = past_a, past_b
        self.known[unit] = len(self.texts)
        self.texts.append(";".join(text))
        self.sizes.append((len(ids_a), len(ids_b), len(groups)))
        self.pairs.append(array("q", pairs))

    @staticmethod
    def speaks(ids: list[int], spoken: list[bytes | None], raw: bytes) -> bool:
        parts = [spoken[i] for i in ids]
        return None not in parts and b"".join(parts) == raw

    def learn(self, units: list[str]) -> None:
        """Tokenize and align word forms, plain ones many in one string."""
        plain = [u for u in units if PLAIN.fullmatch(u)] if self.by_word else []
        for at in range(0, len(plain), 400):
            part = plain[at:at + 400]
            # a line end keeps a form without blank apart from the one before
            line = "".join([u if u[0] == " " else f"\n{u}" for u in part])
            ids_a, ids_b = self.a.encode(line, add_special_tokens=False).ids, self.b.encode(f"\n{line}")[len(self.line_end):]
            raw = line.encode()
            if self.speaks(ids_a, self.bytes_a, raw) and self.speaks(ids_b, self.bytes_b, raw):
                told_a, told_b = self.split(ids_a, self.size_a, part), self.split(ids_b, self.size_b, part)
                if told_a is not None and told_b is not None:
                    for unit, own_a, own_b in zip(part, told_a, told_b):
                        self.remember(unit, own_a, own_b)
        for unit in units:
            if unit not in self.known:
                ids_a = self.a.encode(unit, add_special_tokens=False).ids
                ids_b = self.b.encode(f"\n{unit}")[len(self.line_end):] if self.by_word else self.b.encode(unit[1:])
                raw = unit.encode()
                if self.speaks(ids_a, self.bytes_a, raw) and self.speaks(ids_b, self.bytes_b, raw):
                    self.remember(unit, ids_a, ids_b)
                else:
                    self.known[unit] = 0

    @staticmethod
    def split(ids: list[int], sizes: list[int], units: list[str]) -> list[list[int]] | None:
        """Ids of each unit of a joined string, or None if tokens do not end with them."""
        ends = accumulate(map(sizes.__getitem__, ids))
        place = dict(zip(ends, range(1, len(ids) + 1)))
        out, at, done = [], 0, 0
        for unit in units:
            if unit[0] != " ":  # the line end before it
                done += 1
                at = place.get(done)
            done += len(unit) if unit.isascii() else len(unit.encode())
            past = place.get(done)
            if at is None or past is None:
                return None
            out.append(ids[at:past])
            at = past
        return out

    def forms_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of each text's word forms, in order; none if it has no tokens.  New forms of all texts are learned together."""
        units = [self.units(f" {t}") if t else [] for t in texts]
        found = [list(map(self.known.get, own)) for own in units]
        fresh = dict.fromkeys(u for own, numbers in zip(units, found) if None in numbers for u, n in zip(own, numbers) if n is None)
        if fresh:
            # learning makes many small objects and no cycles: the collector would only walk over them
            gc.disable()
            self.learn(list(fresh))
            gc.enable()
        out = []
        for own, numbers in zip(units, found):
            if None in numbers:
                numbers = list(map(self.known.__getitem__, own))
            out.append(np.array([] if 0 in numbers else numbers, np.int64))
        return out

    def forms(self, text: str | None) -> np.ndarray:
        return self.forms_of([text])[0]

    def shrink(self, kept: np.ndarray) -> None:
        """Forget all word forms but the given ones, which are numbered anew."""
        wanted = set(kept.tolist())
        units = [(u, n) for u, n in self.known.items() if n in wanted]
        texts, sizes, pairs = self.texts, self.sizes, self.pairs
        self.forget()
        for unit, n in units:
            self.known[unit] = len(self.texts)
            self.texts.append(texts[n])
            self.sizes.append(sizes[n])
            self.pairs.append(pairs[n])


def aligner(path_a: str, path_b: str) -> Aligner:
    return worker_cache(f"alignment {path_a} {path_b}", lambda: Aligner(path_a, path_b))


def _block(own: Aligner, number: int, ids: list, numbers: list[np.ndarray], digests: list[str], kinds: pa.Schema) -> pa.RecordBatch:
    """Rows of a block's documents (their distinct word forms) and, last, of the block: its pairs and what pairs its forms have."""
    forms, place = np.unique(np.concatenate(numbers), return_inverse=True)
    pairs = [own.pairs[f] for f in forms.tolist()]
    links = np.array(list(map(len, pairs)), np.int64)
    sizes = np.array([own.sizes[f] for f in forms.tolist()], np.int64).reshape(-1, 3)
    flat = np.frombuffer(b"".join(pairs), np.int64)
    keys, which = np.unique(flat, return_inverse=True)
    times = np.bincount(place, minlength=len(forms))
    counts = np.bincount(which, np.repeat(times, links), len(keys)).astype(np.int64)
    rows, at = [], 0
    for doc_id, own_numbers, digest in zip(ids, numbers, digests):
        mine, n = np.unique(place[at:at + len(own_numbers)], return_counts=True)
        at += len(own_numbers)
        n_a, n_b, n_groups = (sizes[mine] * n[:, None]).sum(axis=0).tolist() if len(mine) else (0, 0, 0)
        rows.append((number, 0, doc_id, n_a, n_b, n_groups, int((links[mine] * n).sum()), digest, mine.astype(np.int32), n.astype(np.int32), None, None))
    rows.append((number, 1, None, 0, 0, 0, 0, None, links.astype(np.int32), which.astype(np.int32), keys, counts))
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), kinds)], schema=kinds)


SUMS = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents aligned and dealt to blocks: see ``_block``."""
    worker_imports(docs.sparkSession)
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    kind = dict(docs.dtypes)["doc_id"]
    schema = (f"block bigint, kind int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "first array<int>, second array<int>, pairs array<bigint>, counts array<bigint>")
    kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, numbers, digests = [], [], []
        for batch in batches:
            doc_ids, column = batch.column("doc_id"), batch.column("text")
            for first, texts in by_size((t.as_py() or "" for t in column), PART_CHARS * 4):
                ids += doc_ids.slice(first, len(texts)).to_pylist()
                told = own.forms_of(texts)
                numbers += told
                lines = [";".join(map(own.texts.__getitem__, forms.tolist())) for forms in told]
                digests += [hashlib.sha256(line.encode()).hexdigest() if line else "" for line in lines]
                size += sum(map(len, texts))
                if size >= block_chars or len(ids) >= block_chars // 16:
                    yield _block(own, number, ids, numbers, digests, kinds)
                    if len(own.known) > KNOWN_WORDS:
                        often, times = np.unique(np.concatenate(numbers), return_counts=True)
                        own.shrink(often[times > 1])
                    number, size = number + 1, 0
                    ids, numbers, digests = [], [], []
        if ids:
            yield _block(own, number, ids, numbers, digests, kinds)

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return staged(slim.mapInArrow(aligned, schema), "aligned")


def block_pairs(aligned: DataFrame) -> DataFrame:
    """Distinct pairs of each block, with their place in it and number of links."""
    some = aligned.filter("kind = 1").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
    return some.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Linked ids of the corpus: pair, a, b, number of links, and whether no other partner of b has more."""
    counts = staged(block_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("links")), "pairs")
    counts = counts.withColumn("a", F.expr(f"pair div {KEEP}").cast("int")).withColumn("b", (F.col("pair") % KEEP).cast("int"))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def _sums(rows: pa.Table) -> pa.Table:
    """Sums of a block's documents over its word forms, from the corpus-wide counts of its pairs."""
    docs, block, told = [rows.filter(pc.equal(rows["kind"], k)) for k in range(3)]
    links, which = [block[name][0].values.to_numpy().astype(np.int64) for name in ("first", "second")]
    total = np.zeros((told.num_rows, 2), np.int64)
    total[told["place"].to_numpy()] = np.stack([told["best"].to_numpy().astype(np.int64), told["links"].to_numpy()], axis=1)
    along = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(total[which], axis=0)])
    ends = np.cumsum(links)
    by_form = along[ends] - along[ends - links]
    sums = np.zeros((docs.num_rows, 2), np.int64)
    for row, (forms, times) in enumerate(zip(docs["first"], docs["second"])):
        sums[row] = (by_form[forms.values.to_numpy()] * times.values.to_numpy()[:, None].astype(np.int64)).sum(axis=0)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1])).append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document: its tokens, groups and links, what its links count in the corpus, and the digest of its groups."""
    aligned = blocks(docs, path_a, path_b, block_chars)
    kind = dict(docs.dtypes)["doc_id"]
    counts = block_pairs(aligned).select("block", "place", "pair").join(pair_counts(aligned).select("pair", "links", "best"), "pair")
    told = counts.select("block", F.lit(2).alias("kind"), "place", "links", "best")
    both = aligned.drop("pairs", "counts").unionByName(told, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(_sums, SUMS.format(kind=kind))


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and the groups of each document as text: ids of A, a bar, ids of B; groups parted by semicolons (null: no tokens)."""
    worker_imports(docs.sparkSession)
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        own, out = aligner(path_a, path_b), []
        for text in texts:
            if len(own.known) > KNOWN_WORDS:
                own.forget()
            out.append(";".join(map(own.texts.__getitem__, own.forms(text).tolist())) or None)
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", told(F.col("text").cast("string")).alias("groups"))
