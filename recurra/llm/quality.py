"""Quality classifier: supervised subword embeddings.

A document is the average of the vectors of its hashed words, character n-grams (over UTF-8 bytes, across blanks) and
repetition marks; a softmax over it gives the class. Vectors and softmax are learned by stochastic gradient descent
with NumPy. Because both averaging and the softmax's input are linear, a learned model is applied as one number per
bucket, the difference of the class scores of its vector, so scoring a text is one table look-up per n-gram.

* Null and empty texts score by the bias alone (an average over nothing is the zero vector); blanks count as characters.
* Very long texts are read in slices; nothing is cut. Repeated rows score alike; an empty table gives an empty result.
* Without labelled rows of both classes every text scores the share of good labels, or 0.5 if there are none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .kernels import NOT_SPACE, odd_randoms, packed, word_hashes

BITS = 18
GRAMS = 4
SLICE = 1 << 20
SAMPLE = 6_000  # most labelled rows that a model is fitted on
THRESHOLD = 0.7


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)


def _gram_buckets(data: np.ndarray):
    """For each n-gram size: buckets by start byte. Each n-gram is hashed from the shorter one before it."""
    values, factor = odd_randoms(256, 91), odd_randoms(1, 92)[0]
    h = values[data]
    for n in range(1, GRAMS + 1):
        if n > 1:
            h = h[:-1] * factor + values[data[n - 1 :]]
        if len(h):
            yield n, _bucket(h, n)


def _marks(hashes: np.ndarray) -> tuple[int, int]:
    """How many words repeat the word before them, how many runs of three words occurred before in the text."""
    if len(hashes) < 2:
        return 0, 0
    same = int((hashes[1:] == hashes[:-1]).sum())
    runs = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)
    return same, len(runs) - len(np.unique(runs))


MARK_WEIGHT = 16  # a repetition counts as much as the n-grams of a few words
MARKS = _bucket(np.array([1, 2], dtype=np.uint64), 99)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for _, _, data, _ in packed([text]):
        data = data[:-1]
        for at in range(0, len(data), SLICE):
            for n, found in _gram_buckets(data[at : at + SLICE + GRAMS - 1]):
                counts += np.bincount(found[:SLICE].astype(np.int64), minlength=1 << BITS)
        words = word_hashes(data, NOT_SPACE)[0]
        counts += np.bincount(_bucket(words, 50).astype(np.int64), minlength=1 << BITS)
        counts[MARKS.astype(np.int64)] += MARK_WEIGHT * np.array(_marks(words))
    ids = np.flatnonzero(counts)
    return ids, (counts[ids] / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, size: int = 8, epochs: int = 10, rate: float = 0.25) -> bytes:
    """One score per bucket, then the bias, as 32-bit floats."""
    table = np.zeros((1 << BITS) + 1, dtype=np.float32)
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        share = min(max(share, 1e-6), 1 - 1e-6)
        table[-1] = np.log(share / (1 - share))
        return table.tobytes()
    rng = np.random.default_rng(5)
    rows = [features(text) for text in texts]
    vectors = rng.uniform(-1, 1, (1 << BITS, size)).astype(np.float32) / size
    squares = np.full(1 << BITS, 1e-8, dtype=np.float32)
    heads = rng.uniform(-1, 1, (size, 2)).astype(np.float32)
    heads_squares = np.full_like(heads, 1e-3)
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    for epoch in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, shares = rows[k]
            mean = shares @ vectors[ids]
            scores = mean @ heads + bias
            scores = np.exp(scores - scores.max())
            error = scores / scores.sum()
            error[int(labels[k])] -= 1
            toward = heads @ error
            change = np.outer(mean, error)
            step = shares[:, None] * toward
            squares[ids] += (step * step).mean(axis=1)
            vectors[ids] -= rate * step / np.sqrt(squares[ids])[:, None]
            heads_squares += change * change
            heads -= rate * change / np.sqrt(heads_squares)
            bias -= 0.02 * error
        rate *= 0.85
    table[:-1] = vectors @ (heads[:, 1] - heads[:, 0])
    table[-1] = bias[1] - bias[0]
    return table.tobytes()


def scores(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    """Probability of the good class for each text."""
    out = np.zeros(len(texts))
    table, bias = model[:-1], float(model[-1])
    for first, last, data, offsets in packed(texts):
        sums, counts = np.zeros(last - first), np.zeros(last - first)
        ends = offsets[1:] - 1  # without the blank that joins
        for at in range(0, len(data), SLICE):
            part = data[at : at + SLICE + GRAMS - 1]
            for n, found in _gram_buckets(part):
                found = found[:SLICE]
                total = np.zeros(len(found) + 1)
                np.cumsum(table[found], out=total[1:], dtype=np.float64)
                low = np.clip(offsets[:-1] - at, 0, len(found))
                high = np.maximum(np.clip(ends - (n - 1) - at, 0, len(found)), low)
                sums += total[high] - total[low]
                counts += high - low
        words, starts = word_hashes(data, NOT_SPACE)
        total = np.zeros(len(words) + 1)
        np.cumsum(table[_bucket(words, 50)], out=total[1:], dtype=np.float64)
        bounds = np.searchsorted(starts, offsets)
        sums += total[bounds[1:]] - total[bounds[:-1]]
        counts += bounds[1:] - bounds[:-1]
        marks = MARK_WEIGHT * np.array([_marks(words[bounds[k] : bounds[k + 1]]) for k in range(last - first)]).reshape(-1, 2)
        sums += marks @ table[MARKS].astype(np.float64)
        counts += marks.sum(axis=1)
        out[first:last] = learning.sigmoid(bias + sums / np.maximum(counts, 1))
    return out


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> np.ndarray:
    """A model of labels.quality, fitted on at most `bound` labelled rows that are not held out."""
    return np.frombuffer(learning.fit(learning.labelled_sample(docs, labels, "quality", bound), train), dtype=np.float32)


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, bound))  # a megabyte, whatever the corpus
    found = learning.scored(docs, lambda texts: scores(texts, model.value))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, bound))
    return learning.kept_rows(docs, lambda texts: np.round(scores(texts, model.value), 9) >= threshold)
