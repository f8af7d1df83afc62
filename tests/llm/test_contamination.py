"""Benchmark decontamination against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import contamination

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def places(text):
    return [(m.group(), *m.span()) for m in PATTERN.finditer((text or "").translate(LOWER))]


def plain(docs, items, window=10):
    """(n_words, n_hit, items, spans) of each document."""
    wanted = {}
    for item, text in items:
        words = [w for w, _, _ in places(text)]
        for at in range(max(len(words) - window, 0) + 1 if words else 0):
            wanted.setdefault(tuple(words[at:at + window]), set()).add(item)
    out = []
    for _, text in docs:
        found, hit, own = places(text), set(), set()
        words = [w for w, _, _ in found]
        for at in range(len(words)):
            for size in range(1, window + 1):
                phrase = tuple(words[at:at + size])
                if len(phrase) == size and phrase in wanted:
                    hit.update(range(at, at + size))
                    own |= wanted[phrase]
        spans = []
        for at in sorted(hit):
            if at - 1 in hit:
                spans[-1] = (spans[-1][0], found[at][2])
            else:
                spans.append(found[at][1:])
        out.append((len(words), len(hit), sorted(str(i) for i in own if i is not None), spans))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    word = lambda: rng.choice(["Ab", "cd", "é", "Ünï", "x1", "9", "λόγος", "zz"])
    line = lambda n: [word() for _ in range(n)]
    items = [(n, " ".join(line(rng.choice([5, 7, 9, 10, 11, 14, 15, 31, 70])))) for n in range(60)]
    items += [(None, " ".join(line(12))), (7, None), (8, ""), (9, "?!"), items[3], items[3], (100, items[20][1]), (101, "one two three four five"), (104, "solo"),
              (102, "one two three four five six seven eight nine ten eleven"), (103, " ".join(line(12_000)))]
    docs = [(n, " ".join(line(rng.randrange(60)))) for n in range(150)]
    for n, (_, text) in enumerate(items[:60]):
        own = line(20)
        own[7:7] = re.split(r"\s+", text)
        docs.append((1000 + n, rng.choice([" ", ", ", "\n\n", " -- ", "_"]).join(own).swapcase()))
    docs += [(1, None), (2, ""), (3, " ,;"), (4, items[-1][1]), (9, "Solo? so lo SOLO"), (5, "one, two three FOUR five! six"), (None, items[10][1]), docs[0], docs[0],
             (6, "One two three four five six seven eight nine TEN."), (7, (items[60][1] + ". ") * 500)]
    docs += [(2000, docs[160][1])] * 20
    return items, docs


@pytest.mark.parametrize("chars", [contamination.SHARD_CHARS, 9_000])
def test_find(spark, case, chars):
    items, docs = case
    bench = spark.createDataFrame(items, "item_id int, text string")
    frame = spark.createDataFrame([(n, d, t, "c", "m") for n, (d, t) in enumerate(docs)], "_mark int, doc_id bigint, text string, contamination string, `a.b` string")
    found = contamination.find(frame, bench, shard_chars=chars)
    assert found.columns == ["_mark", "doc_id", "text", "a.b", "contamination"]
    want = plain(docs, items)
    assert any(w[1] for w in want) and any(not w[1] and w[0] > 20 for w in want)
    rows = sorted(found.collect(), key=lambda r: r[0])
    assert len(rows) == len(docs)
    for row, (words, hit, names, spans) in zip(rows, want):
        got = row.contamination
        assert (got.n_words, got.n_hit, got["items"], [tuple(s) for s in got.spans]) == (words, hit, names, spans), docs[row[0]]
    if chars == contamination.SHARD_CHARS:
        assert contamination.find(frame.limit(0), bench).count() == 0
        none = contamination.find(frame, bench.limit(0)).agg(F.sum("contamination.n_hit"), F.count("*")).first()
        assert tuple(none) == (0, len(docs))


def test_clean(spark, case):
    items, docs = case
    bench = spark.createDataFrame([(i, t, t) for i, t in items], "id int, question string, answer string")
    frame = spark.createDataFrame([(n, d, t, "x") for n, (d, t) in enumerate(docs)], "n int, doc_id bigint, text string, _found string")
    options = {"item": "id", "fields": ("question", "answer")}
    rows = sorted(contamination.clean(frame, bench, **options).collect(), key=lambda r: r.n)
    want = plain(docs, items)
    for row, (_, text), (_, _, _, spans) in zip(rows, docs, want):
        for first, past in reversed(spans):
            text = text[:first] + text[past:]
        assert row.text == text and row._found == "x"
    kept = {r.n for r in contamination.clean(frame, bench, least_share=0.5, **options).collect()}
    assert kept == {n for n, (words, hit, _, _) in enumerate(want) if not (hit and 2 * hit >= words)}


def test_texts_longer_than_a_step(monkeypatch):
    monkeypatch.setattr(contamination, "STEP", 7)
    line = " ".join(f"w{n}" for n in range(10))
    screen = contamination.Screen([("a", line.encode()), ("b", b"x y")])
    words = f"q {line} r x y".encode().split()
    assert screen.scan(words)[0] == [1, 11, 12, 14] and sorted(screen.scan(words)[1]) == ["a", "b"]
