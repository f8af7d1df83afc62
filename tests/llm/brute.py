"""Plain versions of the operators, for small tables."""

import hashlib
import zlib

import numpy as np
import xxhash

from ledgerlens.llm import packing

WORDS = 50


def repeats(rows, window=WORDS):
    """(doc_id, text) to {(doc_id, text): (n_words, n_removed, kept)}."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = {}
    for (d, words), (_, text) in zip(split, rows):
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d, text] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def fingerprint(text, n=4):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks, most=4):
    """(id, fingerprint) pairs to the smallest id reachable, by list position."""
    own = list(range(len(marks)))

    def root(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= most:
                own[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(marks))]


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def token_pieces(rows, capacity=packing.CAPACITY):
    tokenizer = packing.encoder(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    out = {}
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out.setdefault(d, []).append([(p, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                                      for p, a in enumerate(range(0, len(ids), capacity))])
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
