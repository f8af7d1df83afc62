"""Language ID by a string kernel: presence of blended n-grams, Nystroem landmarks, ridge regression.

The kernel of two texts is the number of n-grams of one to three characters that both hold,
over the root of the product of their counts.  Landmark texts span the feature space (their
n-grams are the vocabulary, so n-grams of no landmark add nothing to any kernel value that is
used), one-versus-rest kernel ridge regression is solved in it, and texts are scored in batches
by one matrix product.

Texts are read whole: letters are lower-cased, everything else is a blank.

Defined cases: a text that is null or holds no letter is ``und`` with score 0, and so is every
text when there is nothing to learn from (``keep_known`` still keeps those with a letter); a null id is never held out; equal texts get equal
results; equal scores go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import free_names, held_out, per_text, worker_cache, worker_imports

ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Bounds of the learning sample: rows of one language, and rows in all.  Texts of up to
#: ``LEARN_CHARS`` characters are preferred.
LEARN_PER_LANGUAGE, LEARN_ROWS, LEARN_CHARS = 300, 2000, 20_000
LANDMARKS, RIDGE = 128, 0.1
#: Every letter is below this code point.
POINTS = 1 << 18
#: Slots of the n-gram index (powers of two, least and most), and cells of a presence table.
SLOT_BITS, CELLS = (20, 24), 1 << 21
SHARPNESS = 6.0
#: Below this share of the best language, none stands out and the pipeline's stage rejects the text.
LEAST_SCORE = 0.35


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, blank if none, 0 for the mark between texts."""
    out = np.full(POINTS, 32, np.uint64)
    for code in range(1, POINTS):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    out[0] = 0
    return out


class Grams:
    """Positions of n-grams in a list of texts, as (text, code) arrays."""

    def __init__(self):
        self.letters = _letters()

    def __call__(self, texts: list[str]):
        points = np.frombuffer("\0".join(texts).encode("utf-32-le"), "<u4")
        codes = self.letters[np.minimum(points, POINTS - 1)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])[:len(codes)][keep]
        codes = codes[keep]
        for order in ORDERS:
            gram, size = codes, len(codes) - order + 1
            if size <= 0:
                return
            gram = codes[:size]
            inside = gram != 0
            for step in range(1, order):
                gram = (gram << np.uint64(18)) | codes[step:size + step]
                inside &= codes[step:size + step] != 0
            yield owner[:size], gram | np.uint64(order << 56), inside


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-gram codes
    weights: np.ndarray  # vocabulary x languages


class Scorer:
    """Presence of a vocabulary's n-grams.

    Codes are found by hashed slots.  Codes whose slot another one has are in a further index of the
    same kind, and so on until each has a slot.
    """

    def __init__(self, vocabulary: np.ndarray):
        self.grams = Grams()
        self.size = len(vocabulary)
        self.codes = vocabulary
        self.indexes: list[tuple[np.uint64, int, np.ndarray]] = []
        rest = np.arange(self.size, dtype=np.int32)
        while len(rest):
            bits = min(max(len(rest).bit_length() + 5, SLOT_BITS[0]), SLOT_BITS[1])
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.indexes) + 1)) & (1 << 64) - 1)
            slots = self.slots(vocabulary[rest], factor, bits)
            index = np.full(1 << bits, -1, np.int32)
            index[slots[::-1]] = rest[::-1]
            self.indexes.append((factor, bits, index))
            rest = rest[index[slots] != rest]

    @staticmethod
    def slots(codes: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def presence(self, texts: list[str]) -> np.ndarray:
        """Texts x vocabulary, 1 where the text holds the n-gram."""
        out = np.zeros((len(texts), self.size), np.float32)
        for owner, codes, _ in self.grams(texts):
            for factor, bits, index in self.indexes:
                found = index[self.slots(codes, factor, bits)]
                hit = found >= 0  # an empty slot: in no further index either
                found, owner, codes = found[hit], owner[hit], codes[hit]
                same = self.codes[found] == codes
                out[owner[same], found[same]] = 1
                owner, codes = owner[~same], codes[~same]
        return out

    def presences(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Presence of consecutive texts, in tables of bounded size."""
        step = min(max(CELLS // max(self.size, 1), 1), 128)
        for at in range(0, len(texts), step):
            yield self.presence(texts[at:at + step])


def shared(present: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """Texts x landmarks: n-grams in common over the root of the product of the counts."""
    sizes = np.array([len(m) for m in marks])
    every, owner = np.concatenate(marks), np.repeat(np.arange(len(marks)), sizes)
    common = np.stack([np.bincount(owner, row[every], len(marks)) for row in present])
    return common / np.sqrt(np.maximum(present.sum(1, dtype=np.float64), 1))[:, None] / np.sqrt(np.maximum(sizes, 1))


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Learn from a bounded list of texts, whose first ones become landmarks."""
    names = sorted(set(languages))
    if not names:
        return None
    grams = Grams()
    marks = texts[:LANDMARKS]
    seen: list[np.ndarray] = []
    for mark in marks:
        seen.append(np.unique(np.concatenate([codes[inside] for _, codes, inside in grams([mark])] or [np.zeros(0, np.uint64)])))
    vocabulary = np.unique(np.concatenate(seen))
    scorer = Scorer(vocabulary)
    places = [np.searchsorted(vocabulary, own) for own in seen]  # each landmark's n-grams
    basis = np.concatenate([shared(present, places) for present in scorer.presences(marks)])
    values, vectors = np.linalg.eigh(basis)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = np.concatenate([shared(present, places) for present in scorer.presences(texts)]) @ root
    signs = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    bias = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    solved = np.linalg.solve(bias.T @ bias + RIDGE * np.eye(bias.shape[1]), bias.T @ signs)
    # kernel row = presence @ scaled landmarks / root of the text's count: fold the landmarks into the weights
    weights = np.zeros((len(vocabulary) + 1, len(names)))
    for own, folded in zip(places, root @ solved[:-1]):
        weights[own] += folded / np.sqrt(max(len(own), 1))
    weights[-1] = solved[-1]
    return Model(names, vocabulary, weights.astype(np.float32))


def score(model: Model | None, texts: list[str]) -> list[tuple[str | None, float]]:
    """Language and score of each text, by one matrix product for a batch; without a model, no language for a text with a letter."""
    if model is None:
        return [(None if has_letter(t) else UNKNOWN, 0.0) for t in texts]
    key = hashlib.sha1(model.vocabulary.tobytes()).hexdigest()
    scorer = worker_cache(f"language {key}", lambda: Scorer(model.vocabulary))
    out: list[tuple[str, float]] = []
    at = 0
    for present in scorer.presences(texts):
        part = texts[at:at + len(present)]
        at += len(part)
        margins = present @ model.weights[:-1] / np.sqrt(np.maximum(present.sum(1), 1))[:, None] + model.weights[-1]
        sharp = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True)))
        shares = sharp / sharp.sum(1, keepdims=True)
        best = shares.argmax(1)
        out += [(model.languages[b], float(s[b])) if has_letter(t) else (UNKNOWN, 0.0) for t, b, s in zip(part, best.tolist(), shares)]
    return out


def learn(docs: DataFrame) -> Model | None:
    """Fit on a bounded sample of the documents that are not held out, even over languages."""
    usable = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("mark"),
        held_out(F.col("doc_id")).alias("out")).filter("lang is not null and text is not null and not out").filter(F.col("text").rlike(r"\p{L}"))
    order = (F.length("text") > LEARN_CHARS, F.col("mark"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = usable.withColumn("turn", turn).filter(F.col("turn") <= LEARN_PER_LANGUAGE).orderBy("turn", "lang").limit(LEARN_ROWS)
    rows = chosen.select("text", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(model: Model | None, text: Column) -> Column:
    """Struct of lang and score for a text column; lang is null where there is a letter but no model."""
    @F.pandas_udf("lang string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(per_text(lambda part: score(model, part), texts), columns=["lang", "score"])

    return told(text.cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the same table."""
    worker_imports(docs.sparkSession)
    told = predict(learn(docs), F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), told.alias("told")).select(
        "doc_id", "held_out", F.coalesce("told.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.col("told.score").alias("score"))


def keep_known(docs: DataFrame, wanted: Sequence[str] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents in a language: those without a letter go, and by the model those in none of the ``wanted`` languages (all
    learned ones, if not given) and those whose best language scores below ``least_score``, so that none stands out.
    With nothing to learn languages from, all documents with a letter stay.
    """
    worker_imports(docs.sparkSession)
    (told,) = free_names(docs.columns, "_told")
    lang, best = F.col(told)["lang"], F.col(told)["score"]
    sure = (lang != UNKNOWN) & (best >= least_score)
    if wanted is not None:
        sure = sure & lang.isin(*wanted)
    kept = docs.withColumn(told, predict(learn(docs), F.col("text"))).filter(lang.isNull() | sure)
    return kept.drop(told)
