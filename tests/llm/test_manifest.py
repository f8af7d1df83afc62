"""Merkle proofs against a plain tree."""

import hashlib
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, block int, `kid.node` string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    fold = str.maketrans(manifest.UPPER, manifest.LOWER)
    values = [v if v is None or not lower or n < 4 else v.translate(fold) for n, v in enumerate(row)]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Top of a list of nodes, and (before, after) of each node, level by level."""
    ways, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for way, place in zip(ways, at):
            own = runs[place // 16]
            way.append(("".join(own[:place % 16]), "".join(own[place % 16 + 1:])))
        at = [place // 16 for place in at]
        level = [sha("".join(run)) for run in runs]
    return level[0], ways


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for source in sources:
        own = sorted([r for r in rows if r[1] == source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = (own, *tree([leaf(r) for r in own]))
    root, tops = tree([trees[s][1] for s in sources])
    for source, top in zip(sources, tops):
        own, subroot, ways = trees[source]
        for rank, (row, way) in enumerate(zip(own, ways)):
            way = way + top
            told = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            fold = leaf(row, told)
            for before, after in way:
                fold = sha(before + fold + after)
            out.append((source, row[0], rank, leaf(row), subroot, root, sha("".join(a + b for a, b in way)), fold, fold == root))
    return out


def cases():
    small = [(n, f"s{n % 37}", "en", n, f"Text {n}") for n in range(200)]
    odd = [(1, None, None, None, None), (None, None, "en", 3, "Abc"), (None, "s1", None, 3, "abc"), (5, "S", "en", 0, ""), (5, "S", "en", 0, "X"), (7, "é", "x", 1, "É" * 9),
           (7, "z" * 300, "x", 1, "Long " * 30_000)]
    hot = [(n, "hot", "en", 4, "Same") for n in range(4200)]
    yield "odd", small + odd + [small[3]] * 40 + [(9, "t", "en", 1, "T")] * 17 + [odd[0]] * 3
    yield "two tiers", hot + small[:5]
    yield "one key", [(3, "hot", "en", 4, "Same A")] * 5000 + [(4, "hot", "en", 4, "B")]
    yield "one row", odd[:1]
    yield "one block", [(n, "s", "en", 1, "T") for n in range(16)]
    yield "no rows", []


@pytest.mark.parametrize("name, rows", list(cases()), ids=[n for n, _ in cases()])
def test_proofs(spark, monkeypatch, name, rows):
    monkeypatch.setattr(manifest, "ROWS_PER_SLICE", 300)
    monkeypatch.setattr(manifest, "COPIES_PER_STEP", 7)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = manifest.checked(manifest.proofs(docs))
    got = Counter(map(tuple, found.select("source", "doc_id", "rank", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))
    assert got == Counter(plain(rows) if rows else [])


def test_manifest(spark):
    rows = [(n, "ab"[n % 2], "en", 1, "T") for n in range(40)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = {(r[0], r[4], r[5], 20) for r in plain(rows)}
    assert {tuple(r) for r in manifest.manifest(docs).collect()} == want
