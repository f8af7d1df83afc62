"""Token alignment against whole-text tokenization and plain sets of ends."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(text, a, b):
    """Groups of a text, and links of its tokens by their overlapping bytes."""
    if not text:
        return "", [], 0, 0
    line = f" {text}"
    alphabet = {c: x for c, x in alignment.byte_alphabet().items()}
    ids_a, ids_b = a.encode(line, add_special_tokens=False).ids, b.encode(text)
    spoken_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    spoken_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
    if b"".join(spoken_a) != line.encode() or b"".join(spoken_b) != line.encode():
        return "", [], 0, 0
    ranges = []
    for spoken in (spoken_a, spoken_b):
        at, own = 0, []
        for token in spoken:
            own.append((at, at + len(token)))
            at += len(token)
        ranges.append(own)
    cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    out, at = [], [0, 0]
    for cut in cuts:
        sides = []
        for side, ids in enumerate((ids_a, ids_b)):
            first = at[side]
            while at[side] < len(ids) and ranges[side][at[side]][1] <= cut:
                at[side] += 1
            sides.append(",".join(map(str, ids[first:at[side]])))
        out.append("|".join(sides))
    links, start = [], 0
    for i, (s, e) in zip(ids_a, ranges[0]):
        while ranges[1][start][1] <= s:
            start += 1
        at = start
        while at < len(ids_b) and ranges[1][at][0] < e:
            links.append((i, ids_b[at]))
            at += 1
    return ";".join(out), links, len(ids_a), len(ids_b)


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def texts():
    rng = random.Random(11)
    parts = ["the", "ciónue", "Über", "日本語", "naïve", "don't", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", " ", "<|endoftext|>", "<s>", "<0x41>", "123", "...", "🙂", "é", "\x00",
             "\x1c", "\x85", "ing", "--", "Ġ", "x", ".", ",", "!?", ":;", "3.14", "²", "a.b", "_"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    return out + ["", " ", "\n", "a▁b", "▁", " x", "x ", "x \n", "one word", " ".join(f"w{n % 83}é" for n in range(9_000)), "y" * 3000]


@pytest.mark.parametrize("by_word", [True, False])
def test_groups_of_texts(tokenizers, by_word):
    own = alignment.Aligner(A, B)
    assert own.by_word
    own.by_word = by_word
    for text in texts() if by_word else texts()[:200]:
        want, links, n_a, n_b = plain(text, *tokenizers)
        forms = own.forms(text)
        assert ";".join(own.texts[f] for f in forms) == want, repr(text)
        assert [sum(own.sizes[f][i] for f in forms) for i in (0, 1)] == [n_a, n_b]
        assert Counter(divmod(p, alignment.KEEP) for f in forms for p in own.pairs[f]) == Counter(links)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    own, a, b = CACHE or CACHE.extend([alignment.Aligner(A, B), Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)]) or CACHE
    a.encode_special_tokens = True
    assert ";".join(own.texts[f] for f in own.forms(text)) == plain(text, a, b)[0]


CACHE = []


def test_long_texts_are_halved(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    own = alignment.Aligner(A, B)
    for text in texts():
        parts = list(own.halves(f" {text}"))
        assert "".join(parts) == f" {text}" and (len(text) != 3000 or len(parts) == 1)
        assert ";".join(own.texts[f] for f in own.forms(text)) == plain(text, *tokenizers)[0]


def test_kept_forms_stay_the_same(tokenizers):
    own = alignment.Aligner(A, B)
    first = own.forms_of(texts()[:80])
    often, times = alignment.np.unique(alignment.np.concatenate(first), return_counts=True)
    before = len(own.known)
    own.shrink(often[times > 2])
    assert 0 < len(own.known) < before
    for text, forms in zip(texts()[:120], own.forms_of(texts()[:120])):
        assert ";".join(own.texts[f] for f in forms) == plain(text, *tokenizers)[0]


@given(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40)))
def test_cuts(a, b):
    a, b = sorted(a | {41}), sorted(b | {41})
    assert [a[i - 1] for i, _ in alignment.common_groups(a, b)] == sorted(set(a) & set(b)) == [b[j - 1] for _, j in alignment.common_groups(a, b)]


@pytest.mark.parametrize("chars", [300, alignment.BLOCK_CHARS])
def test_align(spark, tokenizers, monkeypatch, chars):
    monkeypatch.setattr(alignment, "PART_CHARS", 20 if chars == 300 else 65_536)
    some = [t for t in texts()[:60] + texts()[-12:] if "\x00" not in t]
    rows = [(2**60 + n, t) for n, t in enumerate(some)] + [(None, some[0]), (1, None), (5, some[3]), (5, some[3])]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id bigint, text string, n_a int, `a.b` string").repartition(3)
    told = [plain(t, *tokenizers) for _, t in rows]
    counts = Counter(p for _, links, _, _ in told for p in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    want = Counter((d, n_a, n_b, line.count(";") + 1 if line else 0, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(line.encode()).hexdigest() if line else "") for (d, _), (line, links, n_a, n_b) in zip(rows, told))
    found = alignment.align(docs, block_chars=chars)
    assert Counter(map(tuple, found.collect())) == want
    pairs = {(r.a, r.b): (r.links, r.best) for r in alignment.pair_counts(alignment.blocks(docs, block_chars=chars)).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in counts.items()}
    if chars == 300:
        assert {(r.doc_id, r.groups) for r in alignment.groups(docs).collect()} == {(d, line or None) for (d, _), (line, *_) in zip(rows, told)}
        assert alignment.align(docs.limit(0)).count() == 0
