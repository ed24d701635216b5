"""Toxicity: a factorization machine over hashed terms.

score = bias + sum of term weights + sum over pairs of terms of the inner product of their vectors. The pair part
catches what is harmless word by word, such as an insult next to a named group. Terms are the distinct words of a
text and the beginnings of its longer words, as 64-bit hashes. A term takes part if its share differs clearly between
toxic and other training texts, or if it does so together with another term: if the texts that hold both are clearly
more often (or less often) toxic than those that hold either. Words that say nothing alone are found that way. Pairs
are looked for among the PAIR_TERMS most frequent terms that at most half of the texts hold; the rest adds only noise.

* Null, empty and blank texts score by the bias alone. Repeated rows score alike; an empty table gives no rows.
* Very long texts are hashed in pieces and scored on all their distinct terms.
* Without labelled rows of both classes every text scores the share of toxic labels, or 0.5 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .kernels import ALPHANUMERIC, prefix_hashes, words_by_text

COUNT_BITS, LOOK_BITS = 24, 20
FACTORS = 4
SAMPLE = 24_000  # most labelled rows that a model is fitted on
PREFIXES = (4, 5, 6, 7)
LEAST_TEXTS, LEAST_Z = 4, 4.5
PAIR_TERMS, PAIR_TEXTS, PAIR_Z = 2048, 8, 6.0
THRESHOLD = 0.3


def terms(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashes of the words and word beginnings of each text, repeats included."""
    for text, words in zip(texts, words_by_text(texts, ALPHANUMERIC)):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
        yield np.concatenate([words, prefix_hashes(data, ALPHANUMERIC, PREFIXES)])


def _differs(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Whether the shares of toxic and other texts with a term differ clearly (two-proportion z)."""
    seen = toxic + other
    share = seen / (n_toxic + n_other)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_toxic + 1 / n_other))
    return (seen >= LEAST_TEXTS) & (np.abs(toxic / n_toxic - other / n_other) > LEAST_Z * spread)


def _tells(both: np.ndarray, n: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether `both` toxic ones of n texts with two terms are clearly more, or fewer, than either term's share says."""
    out = np.zeros(n.shape, dtype=bool)
    for share, sign in ((high, 1), (low, -1)):
        edge = np.clip(share, 0.5 / np.maximum(n, 1), 1 - 0.5 / np.maximum(n, 1))
        out |= sign * (both - edge * n) > PAIR_Z * np.sqrt(np.maximum(n * edge * (1 - edge), 1e-12))
    return out & (n >= PAIR_TEXTS)


def paired_buckets(texts: list[str], labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Buckets of frequent terms that tell together with another one, from counts of all pairs of them."""
    seen = counts.sum(axis=0)
    often = np.flatnonzero((seen >= PAIR_TEXTS) & (seen <= max(PAIR_TEXTS, len(texts) // 2)))
    often = np.sort(often[np.lexsort((often, -seen[often]))][:PAIR_TERMS])
    if len(often) < 2:
        return often[:0]
    place = np.full(1 << COUNT_BITS, -1, dtype=np.int16)
    place[often] = np.arange(len(often))
    shift, together, toxic = np.uint64(64 - COUNT_BITS), *np.zeros((2, len(often), len(often)), dtype=np.float32)
    for first in range(0, len(texts), 512):
        part, own = texts[first : first + 512], labels[first : first + 512] == 1
        held = np.zeros((len(part), len(often)), dtype=np.float32)
        for k, found in enumerate(terms(part)):
            at = place[found >> shift]
            held[k, at[at >= 0]] = 1
        together += held.T @ held
        toxic += held[own].T @ held[own]
    alone = np.diag(toxic) / np.maximum(np.diag(together), 1)
    tells = _tells(toxic, together, np.maximum.outer(alone, alone), np.minimum.outer(alone, alone))
    # Two terms that stand in the same texts, as a word and its beginning do, are one.
    same = together >= 0.9 * np.minimum.outer(np.diag(together), np.diag(together))
    return often[(tells & ~same).any(axis=1)]


def select(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted hashes of the terms that take part, and each text's places among them.

    Counted by bucket first, so memory is bounded by the buckets; then exactly for the buckets that differ.
    """
    n_toxic, n_other = int(labels.sum()), int(len(labels) - labels.sum())
    counts = np.zeros((2, 1 << COUNT_BITS), dtype=np.int32)
    shift = np.uint64(64 - COUNT_BITS)
    for label, found in zip(labels, terms(texts)):
        counts[int(label), np.unique(found >> shift)] += 1
    open_buckets = _differs(counts[1], counts[0], n_toxic, n_other)
    pairs = paired_buckets(texts, labels, counts)
    open_buckets[pairs] = True
    rows = []
    for found in terms(texts):
        rows.append(np.unique(found[open_buckets[found >> shift]]))
    every = np.concatenate(rows)
    known, place = np.unique(every, return_inverse=True)
    of = np.repeat(labels, [len(row) for row in rows])
    toxic = np.bincount(place, weights=of, minlength=len(known))
    clear = _differs(toxic, np.bincount(place, minlength=len(known)) - toxic, n_toxic, n_other)
    known = known[clear | np.isin(known >> shift, pairs.astype(np.uint64))]
    return known, [np.flatnonzero(np.isin(known, row, assume_unique=True)) for row in rows]


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 0.15) -> bytes:
    """Number of terms, bias, their hashes, weights and vectors."""
    share = float(labels.mean()) if len(labels) else 0.5
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if 0 < share < 1 and len(labels):
        known, rows = select(texts, labels)
    else:
        known, rows = np.zeros(0, dtype=np.uint64), []
    rng = np.random.default_rng(11)
    weights, vectors = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS))
    weight_squares, vector_squares = np.full(len(known), 1e-2), np.full_like(vectors, 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids = rows[k]
            v = vectors[ids]
            total = v.sum(axis=0)
            scale = 1 / max(1, len(ids))
            raw = bias + weights[ids].sum() + 0.5 * scale * ((total * total).sum() - (v * v).sum())
            error = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[k]
            bias -= 0.02 * error
            if len(ids):
                change = error + 1e-4 * weights[ids]
                weight_squares[ids] += change * change
                weights[ids] -= rate * change / np.sqrt(weight_squares[ids])
                turn = error * scale * (total - v) + 1e-4 * v
                vector_squares[ids] += turn * turn
                vectors[ids] -= 0.3 * rate * turn / np.sqrt(vector_squares[ids])
        rate *= 0.85
    head = np.array([len(known), bias])
    return head.tobytes() + known.tobytes() + weights.tobytes() + vectors.tobytes()


class Model:
    """A trained machine: a table of hash beginnings lets most terms through in one look-up."""

    def __init__(self, model: bytes):
        size, self.bias = np.frombuffer(model, count=2)
        n = int(size)
        self.known = np.frombuffer(model, dtype=np.uint64, count=n, offset=16)
        self.weights = np.frombuffer(model, count=n, offset=16 + 8 * n)
        self.vectors = np.frombuffer(model, count=n * FACTORS, offset=16 + 16 * n).reshape(n, FACTORS)
        self.maybe = np.zeros(1 << LOOK_BITS, dtype=bool)
        self.maybe[self.known >> np.uint64(64 - LOOK_BITS)] = True

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of toxicity for each text."""
        out = np.full(len(texts), self.bias)
        for k, found in enumerate(terms(texts)):
            found = np.unique(found[self.maybe[found >> np.uint64(64 - LOOK_BITS)]])
            ids = np.flatnonzero(np.isin(self.known, found, assume_unique=True)) if len(found) else found
            if len(ids):
                v = self.vectors[ids]
                total = v.sum(axis=0)
                out[k] += self.weights[ids].sum() + 0.5 / len(ids) * ((total * total).sum() - (v * v).sum())
        return learning.sigmoid(out)


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text)."""
    sample = learning.labelled_sample(docs, labels, "toxic", bound)
    model = docs.sparkSession.sparkContext.broadcast(learning.fit(sample, train))  # bounded by sample and buckets
    loaded: list[Model] = []

    def score(texts: list[str | None]) -> np.ndarray:
        if not loaded:
            loaded.append(Model(model.value))
        return loaded[0].scores(texts)

    return learning.scored(docs, score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
