"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Terms are words and word beginnings.  Terms that go with marked documents are dealt over lexicon
voters; pattern voters look at the shape of a text.  A generative model with one hidden label per
text estimates each voter's accuracies for both labels, and the correlations that are left between
voters given the label; votes that repeat each other count for less.  The human mark votes too.
Posterior labels of the learning sample train a logistic classifier on term presence, which scores
every whole text.

Defined cases: a null text is read as empty; an empty text gets the classifier's intercept alone;
with no marked rows of both kinds every score is the share of marked rows (0 if there are none);
a null id is never held out; of a repeated id, one mark (the toxic one) and one text (the first in
order) are learned from, so repeats take no places; equal texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import held_out, per_text, worker_cache, worker_imports

#: Bounds of the learning sample: rows of each label, and characters of a text to learn from.
LEARN_PER_LABEL, LEARN_CHARS = 2500, 20_000
LEXICON_VOTERS, LEXICON_TERMS, FEATURES = 24, 480, 1500
STARTS = (3, 4, 5, 6, 7)
WORD = re.compile(r"\w+")
PATTERNS = {
    "repeated letter": re.compile(r"([^\W\d_])\1{3}"),
    "repeated mark": re.compile(r"[!?]{2}"),
    "masked letters": re.compile(r"[^\W\d_][*@#$]+[^\W\d_]"),
    "capitals": re.compile(r"\b[^\W\d_a-zß-ÿ]{5}"),
    "spaced letters": re.compile(r"\b(?:[^\W\d_] ){4}"),
}
#: Words whose features a worker remembers.
KNOWN_WORDS = 200_000


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word + "$"] + [word[:n] for n in STARTS if len(word) >= n]


@dataclass
class Model:
    intercept: float
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # P(vote | clean), P(vote | toxic)
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def hits(index: dict[str, int], words: set[str]) -> set[int]:
    """Features of a text's words."""
    out: set[int] = set()
    for word in words:
        for term in terms_of(word):
            at = index.get(term)
            if at is not None:
                out.add(at)
    return out


def pick_terms(words: list[set[str]], toxic: np.ndarray) -> list[str]:
    """Terms that differ most between the labels, by the score of a two-sample proportion test."""
    counts = [Counter(), Counter()]
    for own, label in zip(words, toxic.tolist()):
        counts[label].update({term for word in own for term in terms_of(word)})
    sizes = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    names = [t for t in counts[1] if counts[1][t] >= 2] + [t for t in counts[0] if counts[1][t] < 2 and counts[0][t] >= 8]
    table = np.array([(counts[0][t], counts[1][t]) for t in names], float).reshape(-1, 2)
    share = table / sizes
    pooled = table.sum(1) / sizes.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / sizes).sum())
    z = (share[:, 1] - share[:, 0]) / spread
    order = sorted(range(len(names)), key=lambda i: (-z[i], names[i]))
    ahead = [names[i] for i in order if z[i] >= 2.0][:FEATURES]
    behind = [names[i] for i in reversed(order) if z[i] <= -4.0][:FEATURES // 10]
    return ahead + behind


def votes_of(texts: list[str], features: list[set[int]], lexicon: int) -> np.ndarray:
    """Texts x voters, 1 where a voter finds what it looks for."""
    out = np.zeros((len(texts), LEXICON_VOTERS + 2 + len(PATTERNS)), np.float64)
    for row, (text, own) in enumerate(zip(texts, features)):
        found = [f for f in own if f < lexicon]
        for f in found:
            out[row, f % LEXICON_VOTERS] = 1
        out[row, LEXICON_VOTERS] = len(found) >= 4
        out[row, LEXICON_VOTERS + 1] = len(found) >= 12
        for k, pattern in enumerate(PATTERNS.values()):
            out[row, LEXICON_VOTERS + 2 + k] = pattern.search(text) is not None
    return out


def label_model(votes: np.ndarray, marks: np.ndarray, weights: np.ndarray, rounds: int = 12):
    """Expectation maximisation: posterior of the hidden label, voter accuracies, conditional correlations.

    The last voter is the human mark.  A voter's evidence is divided by one plus the sum of its
    correlations with the others given the label.
    """
    every = np.concatenate([votes, marks[:, None].astype(float)], axis=1)
    posterior = np.where(marks == 1, 0.95, 0.05)
    for _ in range(rounds):
        parts = []
        noise = np.zeros((every.shape[1],) * 2)
        for share in (1 - posterior, posterior):
            mass = share * weights
            total = mass.sum()
            mean = (mass @ every + 0.5) / (total + 1.0)
            rest = every - mean
            cover = (rest * mass[:, None]).T @ rest / max(total, 1e-9)
            scale = np.sqrt(np.maximum(np.diag(cover), 1e-4))
            noise += np.abs(cover / scale[:, None] / scale[None, :]) / 2
            parts.append(np.clip(mean, 1e-3, 1 - 1e-3))
        np.fill_diagonal(noise, 0)
        noise[noise < 0.1] = 0
        clean, toxic = parts
        toxic[-1], clean[-1] = max(toxic[-1], 0.9), min(clean[-1], 0.1)
        trust = 1 / (1 + noise.sum(1))
        trust[-1] = 1.0
        prior = np.clip((posterior * weights).sum() / weights.sum(), 1e-3, 1 - 1e-3)
        fires, quiet = np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))
        logit = np.log(prior / (1 - prior)) + every @ (fires * trust) + (1 - every) @ (quiet * trust)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, np.stack([clean, toxic], 1), noise


def train_linear(matrix: np.ndarray, target: np.ndarray, weights: np.ndarray, steps: int = 250, decay: float = 2e-4):
    """Logistic regression on soft labels by full-batch Adam."""
    weight, intercept = np.zeros(matrix.shape[1], np.float32), 0.0
    share = (weights / weights.sum()).astype(np.float32)
    m, v = np.zeros(len(weight) + 1, np.float32), np.zeros(len(weight) + 1, np.float32)
    for step in range(1, steps + 1):
        guess = 1 / (1 + np.exp(-np.clip(matrix @ weight + intercept, -30, 30)))
        error = ((guess - target) * share).astype(np.float32)
        slope = np.append(error @ matrix + decay * weight, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        weight, intercept = weight - move[:-1], intercept - float(move[-1])
    return weight.astype(float), intercept


def fit(texts: list[str], toxic: list[int], share: float) -> Model:
    """Learn from a bounded list of texts; ``share`` of all marked rows are toxic."""
    marks = np.array(toxic, int)
    if not len(marks) or marks.min() == marks.max():
        odds = np.clip(share, 1e-3, 1 - 1e-3)
        return Model(float(np.log(odds / (1 - odds))))
    words = [words_of(t) for t in texts]
    names = pick_terms(words, marks)
    index = {t: i for i, t in enumerate(names)}
    features = [hits(index, w) for w in words]
    present = marks.mean()
    weights = np.where(marks == 1, share / present, (1 - share) / (1 - present))
    ahead = min(LEXICON_TERMS, len(names))
    posterior, accuracies, noise = label_model(votes_of(texts, features, ahead), marks, weights)
    matrix = np.zeros((len(texts), len(names)), np.float32)
    for row, own in enumerate(features):
        matrix[row, list(own)] = 1
    learned, intercept = train_linear(matrix, posterior, weights)
    return Model(intercept, index, learned, accuracies, noise)


def score(model: Model, texts: list[str]) -> list[float]:
    out = []
    tag = hash((model.intercept, model.weights.tobytes()))
    known: dict[str, tuple[int, ...]] = worker_cache(f"toxicity {tag}", dict)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for text in texts:
        found: set[int] = set()
        for word in words_of(text):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(sorted({model.index[t] for t in terms_of(word) if t in model.index}))
            if own:
                found.update(own)
        total = model.intercept + sum(model.weights[f] for f in sorted(found))
        out.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the marked documents that are not held out."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter(
        F.col("_toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    counts = {r["_toxic"]: r["count"] for r in marked.groupBy("_toxic").count().collect()}
    single = marked.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    # an ordered limit keeps the first of each task, so no task sorts a label
    per_label = [single.filter(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(LEARN_PER_LABEL) for label in (0, 1)]
    chosen = per_label[0].unionByName(per_label[1])
    body = F.col("text").cast("string")
    usable = docs.select(F.col("doc_id").alias("_id"), body.alias("text")).filter(F.length(body) <= LEARN_CHARS)
    # one text for each of at most 2 * LEARN_PER_LABEL ids
    rows = usable.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("text").alias("text")).orderBy("_id").collect()
    total = sum(counts.values())
    return fit([r["text"] for r in rows], [r["_toxic"] for r in rows], counts.get(1, 0) / total if total else 0.0)


def toxicity(model: Model, text: Column) -> Column:
    """Score from 0 to 1 of a text column."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(per_text(lambda part: score(model, part), texts), dtype="float64")

    return scored(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    worker_imports(docs.sparkSession)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(learn(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score below one half."""
    worker_imports(docs.sparkSession)
    return docs.filter(toxicity(learn(docs, labels), F.col("text")) < 0.5)
