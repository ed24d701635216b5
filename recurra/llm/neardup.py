"""Near-duplicate documents: MinHash with banding, signature check, full check, connected components.

1. Every text becomes its set of word shingles (64-bit hashes), the minima of many universal hashes over that set,
   and one key for each band of minima. Documents with equal sets are one class from here on, so copies cost nothing.
2. Classes that share a band key meet the smallest class of that bucket, not each other. Signatures that agree too
   seldom are dropped, the rest are confirmed on the full sets, and confirmed links give components.
3. Buckets that still hold several components are compared across components, in blocks of bounded size, so
   together both steps decide every pair that shares a band key and none is left out. Texts that have much in common
   but too little for a link are frequent there, so their members get longer signatures. Components are then final.

With the defaults a pair at the threshold shares no band with a probability of (1 - 0.8**4)**32, about 5e-8, and a
signature check drops it with one of about 1e-7 (5.2 standard deviations).

* A null or blank text has an empty set and is linked with nothing, not even with another blank text.
* A null doc_id names no document: the row stays, unlinked, with a null component, and counts as kept.
* Rows that repeat a doc_id are one document; each row is returned. An empty table gives an empty result.
* Very long texts are hashed in pieces and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import connected_components
from .kernels import NOT_SPACE, mix, odd_randoms, shingles, words_by_text

SKETCH = "doc_id long, n_shingles long, set_key string, signature binary, bands array<long>"
FEW, BLOCK = 16, 512
LONG = 1024  # minima in the signatures of step 3, a byte of each


def least_agreeing(minima: int, percent: int) -> int:
    """Agreeing minima below which a pair is too unlikely to reach the similarity."""
    share = percent / 100
    return int(minima * (share - 5.2 * (share * (1 - share) / minima) ** 0.5))


class MinHash:
    """Minima of `bands * rows` multiply-add hashes; the high half of each is kept."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.factors = odd_randoms(bands * rows, 71)[:, None]
        self.shifts = odd_randoms(bands * rows, 72)[:, None]

    def signature(self, found: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(found), 1024):
            hashed = self.factors * found[None, k : k + 1024]
            hashed += self.shifts
            np.minimum(least, hashed.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One key per band; the band's number is part of it."""
        rows = signature.astype(np.uint64).reshape(self.bands, self.rows)
        state = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            state = mix(state * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return state.view(np.int64)


def _set_key(found: np.ndarray) -> str:
    import hashlib

    return hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Set size, set key, signature and band keys of every document; of empty sets only the size."""
    import pyspark.sql.types as T

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
    names = T._parse_datatype_string(SKETCH).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            out: list[list] = [batch.column("doc_id").to_pylist(), [], [], [], []]
            for words in words_by_text(batch.column("text").to_pylist(), NOT_SPACE):
                found = shingles(words, size)
                out[1].append(len(found))
                if len(found):
                    signature = minhash.signature(found)
                    row = (_set_key(found), signature.tobytes(), minhash.keys(signature))
                else:
                    row = (None, None, None)
                for column, value in zip(out[2:], row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """Signatures of a column, one per row."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1 if values else 0)


def long_signatures(texts: DataFrame, size: int) -> DataFrame:
    """(node, signature, long) of texts(node, text, signature): more minima, a byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(LONG, 1)
        for batch in batches:
            marks = [
                minhash.signature(shingles(words, size)).astype(np.uint8).tobytes()
                for words in words_by_text(batch.column("text").to_pylist(), NOT_SPACE)
            ]
            yield batch.select(["node", "signature"]).append_column("long", pa.array(marks, pa.binary()))

    return texts.select("node", "text", "signature").mapInArrow(run, "node long, signature binary, long binary")


def agreeing(pairs: DataFrame, signatures: DataFrame, column: str, kind: type, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures, a column of signatures(node, ...), agree often enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _rows(batch.column("x"), kind), _rows(batch.column("y"), kind)
            near = (x == y).sum(axis=1) >= least_agreeing(x.shape[1], percent)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = signatures.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = signatures.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.

    texts: (node, text). Texts travel, not sets of random hashes: they compress.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = words_by_text(batch.column("x").to_pylist(), NOT_SPACE)
            keep, b, y = [], None, None
            for words, at, text in zip(left, batch.column("b").to_pylist(), batch.column("y")):
                if at != b:  # the join left the pairs of one b together
                    b, y = at, shingles(next(words_by_text([text.as_py()], NOT_SPACE)), size)
                x = shingles(words, size)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _across_small(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in buckets of at most FEW members."""
    x = mixed.filter(F.col("members") <= FEW).select("key", F.col("node").alias("a"), F.col("component").alias("p"))
    y = x.select("key", F.col("a").alias("b"), F.col("p").alias("q"))
    return x.join(y, "key").filter("a < b and p <> q").select("a", "b").distinct()


def _across_large(mixed: DataFrame, signatures: DataFrame, bands: int, rows: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in larger buckets whose signatures, short and long, agree often enough.

    mixed: (key, node, component, members). A bucket is dealt into blocks of about BLOCK members; each pair of blocks
    is one cell, so a cell holds a bounded number of members whatever the size of the bucket. A pair is reported by
    the bucket of its first shared band alone.
    """
    mixed = mixed.filter(F.col("members") > FEW)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = mixed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    cells = dealt.select(
        "key", "node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("key", "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = cells.join(signatures, "node")
    short_least, long_least = least_agreeing(bands * rows, percent), least_agreeing(LONG, percent)

    def compare(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        of, low, high = (k.as_py() for k in key)
        node, part, block = (cell.column(c).to_numpy() for c in ("node", "component", "block"))
        short, long = _rows(cell.column("signature"), np.uint32), _rows(cell.column("long"), np.uint8)
        band = int(np.argmax(MinHash(bands, rows).keys(short[0]) == of))
        a, b = [], []
        second = np.flatnonzero(block == high)
        for i in np.flatnonzero(block == low):
            other = second[(part[second] != part[i]) & ((low != high) | (node[second] > node[i]))]
            same = short[other] == short[i]
            near = same.sum(axis=1) >= short_least
            other, same = other[near], same[near]
            first = same.reshape(len(other), bands, rows).all(axis=2).argmax(axis=1) == band
            other = other[first]
            other = other[(long[other] == long[i]).sum(axis=1) >= long_least]
            a.append(np.minimum(node[i], node[other]))
            b.append(np.maximum(node[i], node[other]))
        empty = np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    return full.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 4
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stage(sketches(docs, size, bands, rows))
    named = sketch.filter("doc_id is not null and set_key is not null")
    classes = stage(named.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    own = named.join(classes, "set_key").filter("doc_id = node")

    keyed = own.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last")
    shared = stage(keyed.join(buckets.select("key", "centre"), "key"))
    needed = shared.select("node").distinct()
    signatures = own.select("node", "signature").dropDuplicates(["node"]).join(needed, "node", "left_semi")
    text = docs.select(F.col("doc_id").alias("node"), "text")
    texts = stage(text.join(signatures, "node").dropDuplicates(["node"]))
    marks = texts.select("node", "signature")

    pairs = shared.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(confirmed(agreeing(pairs, marks, "signature", np.uint32, percent), texts, size, percent))
    found = stage(connected_components(links))

    parts = shared.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = parts.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members")
    ).filter("least < most")
    mixed = stage(parts.join(several.select("key", "members"), "key"))
    marks = stage(long_signatures(texts.join(mixed.select("node").distinct(), "node", "left_semi"), size))
    few = agreeing(_across_small(mixed), marks, "long", np.uint8, percent)
    across = few.union(_across_large(mixed, marks, bands, rows, percent)).distinct()
    more = stage(confirmed(across, texts, size, percent))
    if not more.isEmpty():
        found = stage(connected_components(links.union(more)))

    of_class = classes.join(found, "node", "left").select(
        F.col("set_key").alias("key"), F.coalesce("component", "node").alias("component_id")
    )
    # Empty sets join nothing; a key of their own keeps them from meeting in one task.
    placed = sketch.select("doc_id", "n_shingles", F.coalesce("set_key", F.col("doc_id").cast("string")).alias("key"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return placed.join(of_class, "key", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
