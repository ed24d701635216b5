"""Histogram trees for many jobs at once: every fold of every tree shares the passes over the rows.

Values become bin codes first; the bins' edges come from Spark's mergeable quantile sketch, and are all distinct
values where these are few. A split is a bin code, chosen from sums per (job, node, feature, code): class weights for
impurity trees, first and second derivatives for boosted ones. A job is one tree of one fold; a row belongs to the
training part of every fold but its own.

* Small training sets (LOCAL_BYTES of packed rows, for boosted trees SUBTREE_ROWS) are grown job by job in tasks, all trees of a chunk side by side in
  array operations. Larger ones are never gathered: tasks sum cells over blocks of rows, one aggregation per level
  adds them up, one small group per node picks its split. Nodes of at most SUBTREE_ROWS rows leave that: their rows
  are shuffled once and one task grows all that lies below. Both ways use the same kernels and choose the same splits.
* Whatever is random (a row's weight in a bag, the features of a node) is a hash of the row, the tree and the seed. It
  does not depend on the fold, the partitioning or on repeated tasks: a fold trained alone has the same trees.
* Forests stay in Spark until rows are scored; then the driver holds those of one fold at a time, packed in tasks: at
  most trees x 2**(depth + 1) nodes of 24 bytes, set by parameters. While a model is grown it holds the upper nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

BINS = 256
LOCAL_BYTES = 1 << 23
BLOCK_ROWS = 8192
SUBTREE_ROWS = 1 << 17  # a node of at most so many rows is grown to its end in one task
ENTRIES = 1 << 21  # (row, tree, feature) triples that a kernel holds at once
RESTAGE = 10  # boosting rounds after which the rows' margins are written anew
HEAPS = 4096  # node numbers: the root is 1, children of k are 2k and 2k + 1
PACKED = "n long, codes binary, y binary, fold binary, key binary, margin binary"
MODEL = "fold int, tree int, heap int, feature int, threshold double, value double"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(*parts) -> np.ndarray:
    """64-bit hash of arrays that broadcast against each other."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            out = mix(np.asarray(part).astype(np.int64).astype(np.uint64) + out * np.uint64(0x9E3779B97F4A7C15))
    return out


def uniform(*parts) -> np.ndarray:
    return (hashed(*parts) >> np.uint64(11)) * 2.0**-53


# Cumulative Poisson(1) probabilities.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 12.0)))))


@dataclass(frozen=True)
class Impurity:
    """Trees of least Gini impurity over class-weighted rows; sums are (weight of 0, weight of 1, rows)."""

    trees: int = 1
    depth: int = 10
    min_split: int = 2
    min_leaf: int = 1
    features: int | None = None  # features tried per node, all without a number
    bagged: bool = False
    balanced: bool = True
    seed: int = 42
    boosted = False

    def is_open(self, totals: np.ndarray) -> np.ndarray:
        return (totals[:, 2] >= max(2, self.min_split)) & (np.minimum(totals[:, 0], totals[:, 1]) > 0)

    def gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        def loss(s):
            return 2 * s[:, 0] * s[:, 1] / np.maximum(s[:, 0] + s[:, 1], 1e-300)

        fits = (left[:, 2] >= self.min_leaf) & (right[:, 2] >= self.min_leaf)
        return np.where(fits, loss(left + right) - loss(left) - loss(right), -np.inf)

    def least_gain(self) -> float:
        return -1e-9

    def value(self, totals: np.ndarray) -> np.ndarray:
        return totals[:, 1] / np.maximum(totals[:, 0] + totals[:, 1], 1e-300)

    def tried(self, tree: np.ndarray, heap: np.ndarray, width: int) -> np.ndarray:
        """Features of each node, ascending."""
        m = min(self.features or width, width)
        if m == width:
            return np.broadcast_to(np.arange(width), (len(tree), width))
        draws = hashed(self.seed + 1, tree[:, None], heap[:, None], np.arange(width)[None, :])
        return np.sort(np.argpartition(draws, m - 1, axis=1)[:, :m], axis=1)

    def weights(self, key: np.ndarray, tree: np.ndarray) -> np.ndarray:
        if not self.bagged:
            return np.ones(np.broadcast(key, tree).shape)
        return np.searchsorted(POISSON, uniform(self.seed, tree, key), side="right").astype(float)


@dataclass(frozen=True)
class Boosting:
    """Second-order boosted trees of the logistic loss; sums are (gradient, hessian, rows)."""

    trees: int = 300
    depth: int = 6
    rate: float = 0.1
    alpha: float = 0.1
    penalty: float = 1.0
    gamma: float = 0.0
    min_weight: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42
    boosted = True

    def is_open(self, totals: np.ndarray) -> np.ndarray:
        return totals[:, 1] >= 2 * self.min_weight

    def _best(self, s: np.ndarray) -> np.ndarray:
        cut = np.sign(s[:, 0]) * np.maximum(np.abs(s[:, 0]) - self.alpha, 0)
        return cut * cut / (s[:, 1] + self.penalty)

    def gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        fits = (left[:, 1] >= self.min_weight) & (right[:, 1] >= self.min_weight) & (right[:, 2] > 0)
        return np.where(fits, (self._best(left) + self._best(right) - self._best(left + right)) / 2 - self.gamma, -np.inf)

    def least_gain(self) -> float:
        return 1e-6

    def value(self, totals: np.ndarray) -> np.ndarray:
        cut = np.sign(totals[:, 0]) * np.maximum(np.abs(totals[:, 0]) - self.alpha, 0)
        return -self.rate * cut / (totals[:, 1] + self.penalty)

    def tried(self, tree: np.ndarray, heap: np.ndarray, width: int) -> np.ndarray:
        m = max(1, round(self.columns * width))
        if m == width:
            return np.broadcast_to(np.arange(width), (len(tree), width))
        draws = hashed(self.seed + 1, tree[:, None], np.arange(width)[None, :])
        return np.sort(np.argpartition(draws, m - 1, axis=1)[:, :m], axis=1)

    def weights(self, key: np.ndarray, tree: np.ndarray) -> np.ndarray:
        return (uniform(self.seed, tree, key) < self.rows).astype(float)


# --- rows as bin codes -------------------------------------------------------------------------


def bin_edges(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of every feature's bins, the last one open: distinct values where these are few, else quantiles."""
    long = rows.select(F.posexplode("x").alias("k", "v"))
    shares = [(j + 1) / bins for j in range(bins - 1)]
    some = long.groupBy("k", "v").agg(F.lit(1)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    few = [row.k for row in some.filter(F.col("n") <= bins).collect()]  # numbers of features
    cut = F.percentile_approx("v", shares, 50 * bins)
    edges = {row.k: row.e for row in long.filter(~F.col("k").isin(few)).groupBy("k").agg(cut.alias("e")).collect()}
    if few:  # at most `bins` values a feature
        sets = long.filter(F.col("k").isin(few)).groupBy("k").agg(F.sort_array(F.collect_set("v")).alias("e"))
        edges |= {row.k: row.e[:-1] for row in sets.collect()}
    return [np.unique(np.asarray(edges[k], dtype=float)) for k in sorted(edges)]


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes: the number of edges below a value."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


@dataclass
class Block:
    codes: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    margin: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        n = row["n"]
        arrays = [np.frombuffer(row[c], dtype=t) for c, t in (("codes", np.uint8), ("y", float), ("fold", np.int32), ("key", np.int64), ("margin", float))]
        return cls(arrays[0].reshape(n, -1), *arrays[1:4], arrays[4].reshape(-1, n))

    def row(self) -> dict:
        data = {c: np.ascontiguousarray(getattr(self, c)).tobytes() for c in ("codes", "y", "fold", "key", "margin")}
        return {"n": len(self.y)} | data


def record_batch(rows: list[dict], like: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in like.items()], list(like))


PACKED_TYPES = {"n": pa.int64(), "codes": pa.binary(), "y": pa.binary(), "fold": pa.binary(), "key": pa.binary(), "margin": pa.binary()}


def packed(rows: DataFrame, positive, edges: list[np.ndarray], folds: int, size: int) -> DataFrame:
    """Blocks of up to `size` rows of (row_id, label, x, fold), in the order of their hashes within a partition."""

    def flush(parts: list[tuple]) -> dict:
        x, y, fold, key = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((y, fold, key))
        codes = coded(x[order], edges)
        return Block(codes, y[order], fold[order], key[order], np.zeros((folds, len(y)))).row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            parts.append((flat.reshape(batch.num_rows, -1), *(batch.column(c).to_numpy() for c in ("y", "fold", "key"))))
            held += batch.num_rows
            if held >= size:
                yield record_batch([flush(parts)], PACKED_TYPES)
                parts, held = [], 0
        if parts:
            yield record_batch([flush(parts)], PACKED_TYPES)

    columns = (F.col("label") == positive).cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), F.xxhash64("row_id").alias("key")
    return rows.select("x", *columns).mapInArrow(run, PACKED)


# --- kernels -----------------------------------------------------------------------------------


def cells(keys: np.ndarray, sums: np.ndarray, repeat: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows; row k of `sums` stands for keys k*repeat to (k+1)*repeat-1."""
    span = int(keys.max(initial=-1)) + 1
    if span <= 4 * len(keys):
        wide = [np.bincount(keys, np.repeat(s, repeat), span) for s in sums.T]
        used = np.flatnonzero(wide[-1])
        return used, np.stack([w[used] for w in wide], axis=1)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.add.reduceat(sums[order // repeat], starts, axis=0)


def shared_cells(codes: np.ndarray, rows: np.ndarray, at: np.ndarray, sums: np.ndarray, features: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``cells`` returns where all nodes try the same features, added up feature by feature.

    The table of one feature stays in the processor's cache; the last of the sums counts rows.
    """
    first = at * BINS
    wide = np.empty((3, nodes, len(features), BINS))
    for slot, feature in enumerate(features):
        keys = first + codes[:, feature][rows]
        for part, s in zip(wide, (sums[:, 0], sums[:, 1], None)):
            part[:, slot] = np.bincount(keys, s, nodes * BINS).reshape(nodes, BINS)
    wide = wide.reshape(3, -1)
    used = np.flatnonzero(wide[-1])
    return used, wide[:, used].T


def best_splits(keys: np.ndarray, sums: np.ndarray, slots: int, rule) -> tuple[np.ndarray, ...]:
    """(node, slot, code) of the best split of each node that has one; keys are ((node * slots) + slot) * BINS + code.

    Equal gains go to the first feature, then to the smallest code.
    """
    line = keys // BINS
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    sizes = np.diff(np.concatenate((first, [len(keys)])))
    running = np.cumsum(sums, axis=0)
    before = np.repeat(running[first] - sums[first], sizes, axis=0)
    whole = np.repeat(np.add.reduceat(sums, first, axis=0), sizes, axis=0)
    left = running - before
    gain = rule.gain(left, whole - left)
    gain[np.concatenate((first[1:], [len(keys)])) - 1] = -np.inf  # nothing is right of a feature's last code
    node = line // slots
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    top = np.maximum.reduceat(gain, start)
    # Sums in another order differ in their last digits; such gains count as equal.
    near = np.repeat(top - 1e-9 * np.maximum(1.0, np.abs(top)), np.diff(np.concatenate((start, [len(keys)]))))
    place = np.flatnonzero(gain >= near)
    _, once = np.unique(node[place], return_index=True)
    place = place[once][top > rule.least_gain()]
    return node[place], line[place] % slots, keys[place] % BINS


def totals_of(index: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, s, n) for s in sums.T], axis=1)


def grown(codes: np.ndarray, rows: np.ndarray, trees: np.ndarray, sums: np.ndarray, rule, top: int = 1) -> dict[str, np.ndarray]:
    """Nodes (tree, heap, feature, code, value) of the trees over the entries (row, tree, sums); leaves have feature -1.

    ``top`` is the node that all entries have come to.
    """
    width, heap = codes.shape[1], np.full(len(rows), top, dtype=np.int64)
    found = []
    for depth in range(int(top).bit_length() - 1, rule.depth + 1):
        nodes, index = np.unique(trees * HEAPS + heap, return_inverse=True)
        totals = totals_of(index, sums, len(nodes))
        feature, code = np.full(len(nodes), -1), np.zeros(len(nodes), dtype=np.int64)
        live = rule.is_open(totals) if depth < rule.depth else np.zeros(len(nodes), dtype=bool)
        if live.any():
            tried = rule.tried(nodes[live] // HEAPS, nodes[live] % HEAPS, width)
            slots, own = tried.shape[1], np.flatnonzero(live[index])
            at = (np.cumsum(live) - 1)[index[own]]
            if len(tried) * BINS <= 4 * len(own) and (tried == tried[0]).all():
                summed = shared_cells(codes, rows[own], at, np.asfortranarray(sums[own]), tried[0], len(tried))
            else:
                keys = (at[:, None] * slots + np.arange(slots)) * BINS + codes[rows[own][:, None], tried[at]]
                summed = cells(keys.ravel(), sums[own], slots)
            node, slot, cut = best_splits(*summed, slots, rule)
            place = np.flatnonzero(live)[node]
            feature[place], code[place] = tried[node, slot], cut
        found.append((nodes // HEAPS, nodes % HEAPS, feature, code, rule.value(totals)))
        on = np.flatnonzero(feature[index] >= 0)
        if not len(on):
            break
        rows, trees, sums, index = rows[on], trees[on], sums[on], index[on]
        heap = 2 * heap[on] + (codes[rows, feature[index]] > code[index])
    return dict(zip(("tree", "heap", "feature", "code", "value"), map(np.concatenate, zip(*found))))


def class_factors(y: np.ndarray) -> tuple[float, float]:
    """Balanced weights of the two classes; 1 where a class is missing."""
    ones = float(y.sum())
    return tuple(len(y) / (2 * c) if 0 < c < len(y) else 1.0 for c in (len(y) - ones, ones))


def impurity_sums(y: np.ndarray, weight: np.ndarray, factors: tuple[float, float]) -> np.ndarray:
    return np.stack([weight * (y == 0) * factors[0], weight * (y == 1) * factors[1], np.ones(len(y))], axis=1)


def newton_sums(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.stack([p - y, np.maximum(p * (1 - p), 1e-16), np.ones(len(y))], axis=1)


def routed(codes: np.ndarray, nodes: dict[str, np.ndarray]) -> np.ndarray:
    """Value of one tree for every row of codes."""
    order = np.argsort(nodes["heap"])
    heaps, feature, code, value = (nodes[c][order] for c in ("heap", "feature", "code", "value"))
    at = np.zeros(len(codes), dtype=np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return value[at]
        here = at[inner]
        at[inner] = np.searchsorted(heaps, 2 * heaps[here] + (codes[inner, feature[here]] > code[here]))


# --- small training sets: jobs in tasks --------------------------------------------------------


def forest_of(block: Block, fold: int, first: int, last: int, rule: Impurity) -> dict[str, np.ndarray]:
    inside = block.fold != fold
    codes, y, key = block.codes[inside], block.y[inside], block.key[inside]
    factors = class_factors(y) if rule.balanced else (1.0, 1.0)
    weight = rule.weights(key[None, :], np.arange(first, last)[:, None])
    trees, rows = np.nonzero(weight)
    if not len(rows):
        return {c: np.zeros(0, dtype=np.int64) for c in ("tree", "heap", "feature", "code", "value")}
    return grown(codes, rows, trees + first, impurity_sums(y[rows], weight[trees, rows], factors), rule)


def boosted_of(block: Block, fold: int, rule: Boosting) -> dict[str, np.ndarray]:
    inside = block.fold != fold
    codes, y, key = np.asfortranarray(block.codes[inside]), block.y[inside], block.key[inside]
    margin, parts = np.zeros(len(y)), []
    for k in range(rule.trees):
        rows = np.flatnonzero(rule.weights(key, np.array(k)))
        if len(rows):
            nodes = grown(codes, rows, np.full(len(rows), k), newton_sums(y[rows], margin[rows]), rule)
            margin += routed(codes, nodes)
            parts.append(nodes)
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in ("tree", "heap", "feature", "code", "value")}


def _local(blocks: DataFrame, folds: list[int], rule, edges: list[np.ndarray], n: int) -> DataFrame:
    width = len(edges)
    slots = width if rule.boosted else min(rule.features or width, width)
    chunk = rule.trees if rule.boosted else max(1, min(rule.trees, ENTRIES // max(1, n * slots)))
    jobs = [(f, t, min(t + chunk, rule.trees)) for f in folds for t in range(0, rule.trees, chunk)]
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, a, b in jobs]))
    dealt = blocks.select("*", listed.alias("job")).select("*", "job.f", "job.a", "job.b").drop("job")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                nodes = boosted_of(block, row["f"], rule) if rule.boosted else forest_of(block, row["f"], row["a"], row["b"], rule)
                yield model_batch(np.full(len(nodes["heap"]), row["f"]), nodes, edges)

    return stage(dealt.repartition(len(jobs)).mapInArrow(run, MODEL))


def model_batch(fold: np.ndarray, nodes: dict[str, np.ndarray], edges: list[np.ndarray]) -> pa.RecordBatch:
    cut = [float(edges[f][c]) if f >= 0 else None for f, c in zip(nodes["feature"].astype(int), nodes["code"].astype(int))]
    ints = [pa.array(v.astype(np.int32), pa.int32()) for v in (fold, nodes["tree"], nodes["heap"], nodes["feature"])]
    values = pa.array(nodes["value"].astype(float), pa.float64())
    return pa.RecordBatch.from_arrays([*ints, pa.array(cut, pa.float64()), values], [c.split()[0] for c in MODEL.split(", ")])


# --- large training sets: one aggregation per level ----------------------------------------------


class Growing:
    """The splits so far of some jobs: arrays by (job, heap).

    The feature is -1 for a leaf, -2 for a node not decided yet and -3 for one whose subtree a task grows.
    """

    def __init__(self, jobs: list[tuple[int, int]], depth: int, rows: dict[int, int], alone: int):
        self.folds, self.trees = (np.array(v) for v in zip(*jobs))
        self.feature = np.full((len(jobs), 2 << depth), -1, dtype=np.int16)
        self.alone = alone  # most rows of a subtree that one task grows
        self.open(np.arange(len(jobs)), np.ones(len(jobs), dtype=np.int64), np.array([rows[f] for f in self.folds]))
        self.code = np.zeros((len(jobs), 2 << depth), dtype=np.uint8)
        self.value = np.zeros((len(jobs), 2 << depth))

    def open(self, job: np.ndarray, heap: np.ndarray, size: np.ndarray) -> None:
        """Mark nodes of at most ``size`` rows as not decided yet."""
        self.feature[job, heap] = np.where(size <= self.alone, -3, -2)

    def place(self, codes: np.ndarray, rows: np.ndarray, jobs: np.ndarray) -> np.ndarray:
        """The node that each entry (row, job) has come to."""
        heap = np.ones(len(rows), dtype=np.int64)
        while True:
            feature = self.feature[jobs, heap]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return heap
            right = codes[rows[inner], feature[inner]] > self.code[jobs[inner], heap[inner]]
            heap[inner] = 2 * heap[inner] + right

    def nodes(self, job: int) -> dict[str, np.ndarray]:
        known = [1]
        for heap in known:
            if self.feature[job, heap] >= 0:
                known += [2 * heap, 2 * heap + 1]
        heap = np.array(known)
        own = {"feature": self.feature[job, heap].astype(int), "code": self.code[job, heap].astype(int), "value": self.value[job, heap]}
        return {"tree": np.full(len(heap), self.trees[job]), "heap": heap} | own


CELLS = "job int, heap int, feature int, code int, s0 double, s1 double, s2 double"
SPLITS = "job int, heap int, feature int, code int, s0 double, s1 double, s2 double, left long"
PARTS = "job int, heap int, codes binary, key binary, s0 binary, s1 binary"
SUBTREES = "job int, heap int, code int, " + MODEL.replace("heap int", "at int")


def _entries(block: Block, state: Growing, jobs: np.ndarray, rule, factors, margins) -> tuple[np.ndarray, ...]:
    """(row, job, sums) of the rows that take part in each job."""
    inside = block.fold[None, :] != state.folds[jobs][:, None]
    weight = rule.weights(block.key[None, :], state.trees[jobs][:, None]) * inside
    own, rows = np.nonzero(weight)
    if rule.boosted:
        return rows, jobs[own], newton_sums(block.y[rows], margins[jobs[own], rows])
    y, share = block.y[rows], np.array([factors[f] for f in state.folds[jobs]])[own]
    picked = np.where(y == 1, share[:, 1], share[:, 0]) * weight[own, rows]
    return rows, jobs[own], np.stack([picked * (y == 0), picked * (y == 1), np.ones(len(rows))], axis=1)


def _open_entries(blocks: DataFrame, state: Growing, rule, width: int, factors: dict, margins_of, marked: int, schema: str, kernel) -> DataFrame:
    """What ``kernel`` yields of the entries (row, job, sums, heap) whose node is marked so, a few jobs of a block at a time."""
    shared = blocks.sparkSession.sparkContext.broadcast((state, factors))  # splits of at most 2**(depth+1) nodes a job
    slots_of = width if rule.boosted else min(rule.features or width, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, factors = shared.value
        wanted = np.flatnonzero((state.feature == marked).any(axis=1))
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                margins = margins_of(block)
                step = max(1, ENTRIES // max(1, len(block.y) * slots_of))
                for first in range(0, len(wanted), step):
                    rows, own, sums = _entries(block, state, wanted[first : first + step], rule, factors, margins)
                    heap = state.place(block.codes, rows, own)
                    on = np.flatnonzero(state.feature[own, heap] == marked)
                    if len(on):
                        yield from kernel(state, block, rows[on], own[on], sums[on], heap[on])

    return blocks.mapInArrow(run, schema)


def level_cells(blocks: DataFrame, state: Growing, rule, width: int, last: bool, factors: dict, margins_of) -> DataFrame:
    """Sums per (job, node, feature, code) of the open nodes; feature -1 holds a node's own sums."""

    def kernel(state: Growing, block: Block, rows: np.ndarray, own: np.ndarray, sums: np.ndarray, heap: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, index = np.unique(own * HEAPS + heap, return_inverse=True)
        job, at = nodes // HEAPS, nodes % HEAPS
        out = [(job, at, np.full(len(nodes), -1), np.zeros(len(nodes)), totals_of(index, sums, len(nodes)))]
        if not last:
            tried = rule.tried(state.trees[job], at, width)
            slots = tried.shape[1]
            keys = (index[:, None] * slots + np.arange(slots)) * BINS + block.codes[rows[:, None], tried[index]]
            found, added = cells(keys.ravel(), sums, slots)
            node, slot = found // BINS // slots, found // BINS % slots
            out.append((job[node], at[node], tried[node, slot], found % BINS, added))
        for *ints, added in out:
            columns = [pa.array(np.asarray(v).astype(np.int32), pa.int32()) for v in ints]
            columns += [pa.array(s, pa.float64()) for s in np.ascontiguousarray(added.T)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CELLS.split(", ")])

    each = _open_entries(blocks, state, rule, width, factors, margins_of, -2, CELLS, kernel)
    return each.groupBy("job", "heap", "feature", "code").agg(*[F.sum(s).alias(s) for s in ("s0", "s1", "s2")])


def subtrees(blocks: DataFrame, state: Growing, rule, edges: list[np.ndarray], factors: dict, margins_of) -> DataFrame:
    """All nodes of the subtrees that single tasks grow: job, the subtree's root, code and what a model holds (heap as ``at``).

    A block sends the codes and sums of a node's rows as one record, so what is shuffled are the rows of each tree once.
    """
    width, names = len(edges), [c.split()[0] for c in SUBTREES.split(", ")]
    folds, trees = state.folds, state.trees

    def kernel(state: Growing, block: Block, rows: np.ndarray, own: np.ndarray, sums: np.ndarray, heap: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(own * HEAPS + heap, kind="stable")
        nodes, first = np.unique((own * HEAPS + heap)[order], return_index=True)
        out = [part for part in np.split(order, first[1:])]
        binaries = [[np.ascontiguousarray(v[p]).tobytes() for p in out] for v in (block.codes[rows], block.key[rows], sums[:, 0], sums[:, 1])]
        ints = [pa.array(v.astype(np.int32), pa.int32()) for v in (nodes // HEAPS, nodes % HEAPS)]
        yield pa.RecordBatch.from_arrays([*ints, *[pa.array(v, pa.binary()) for v in binaries]], [c.split()[0] for c in PARTS.split(", ")])

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        job, top = (k.as_py() for k in key)
        keys, s0, s1 = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("key", np.int64), ("s0", float), ("s1", float)))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint8).reshape(len(keys), -1)
        sums = np.stack([s0, s1, np.ones(len(keys))], axis=1)
        order = np.lexsort((s1, s0, keys))
        nodes = grown(np.asfortranarray(codes) if rule.boosted else codes, order, np.full(len(order), trees[job]), sums[order], rule, top)
        own = model_batch(np.full(len(nodes["heap"]), folds[job]), nodes, edges)
        more = [pa.array(np.broadcast_to(np.asarray(v, dtype=np.int32), len(nodes["heap"]))) for v in (job, top, nodes["code"])]
        return pa.table([*more, *own.columns], names=names)

    each = _open_entries(blocks, state, rule, width, factors, margins_of, -3, PARTS, kernel)
    return each.groupBy("job", "heap").applyInArrow(grow, SUBTREES)


def chosen_splits(summed: DataFrame, rule, last: bool = False) -> DataFrame:
    """The decision of every node from its cells: (job, heap, feature or -1, code, sums)."""

    def run(table: pa.Table) -> pa.Table:
        feature, code = table.column("feature").to_numpy(), table.column("code").to_numpy()
        sums = np.stack([table.column(s).to_numpy() for s in ("s0", "s1", "s2")], axis=1)
        whole = sums[feature == -1]
        pick, left = (-1, 0), 0
        if not last and rule.is_open(whole)[0]:
            own = np.flatnonzero(feature >= 0)
            names, slot = np.unique(feature[own], return_inverse=True)
            keys = slot * BINS + code[own].astype(np.int64)
            order = np.argsort(keys)
            _, best, cut = best_splits(keys[order], sums[own][order], len(names), rule)
            if len(best):
                pick = (int(names[best[0]]), int(cut[0]))
                left = round(sums[(feature == pick[0]) & (code <= pick[1]), 2].sum())
        head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("job", "heap")]
        columns = head + [pa.array([v], pa.int32()) for v in pick] + [pa.array([s], pa.float64()) for s in whole[0]]
        columns.append(pa.array([left], pa.int64()))
        return pa.table(columns, names=[c.split()[0] for c in SPLITS.split(", ")])

    return summed.groupBy("job", "heap").applyInArrow(run, SPLITS)


def _grow_upper(blocks: DataFrame, state: Growing, rule, width: int, factors: dict, margins_of) -> None:
    """Level by level, all nodes that have more rows than one task takes."""
    for depth in range(rule.depth + 1):
        if not (state.feature == -2).any():
            return
        last = depth == rule.depth
        rows = chosen_splits(level_cells(blocks, state, rule, width, last, factors, margins_of), rule, last).collect()
        state.feature[state.feature == -2] = -1  # nodes that no row has come to
        if not rows:
            return
        job, heap, feature, code = (np.array([r[c] for r in rows]) for c in range(4))
        state.feature[job, heap], state.code[job, heap] = feature, code
        state.value[job, heap] = rule.value(np.array([tuple(r)[4:7] for r in rows], dtype=float))
        size, left = (np.array([r[c] for r in rows]) for c in ("s2", "left"))
        inner = np.flatnonzero(feature >= 0)
        for side, part in ((0, left), (1, size - left)):
            state.open(job[inner], 2 * heap[inner] + side, part[inner])


def _distributed(blocks: DataFrame, folds: list[int], rule, edges: list[np.ndarray], alone: int) -> DataFrame:
    spark, width = blocks.sparkSession, len(edges)
    counts = fold_counts(blocks)
    factors, sizes = {}, {}
    for f in folds:
        n, ones = sum(c[0] for k, c in counts.items() if k != f), sum(c[1] for k, c in counts.items() if k != f)
        pair = (n / (2 * (n - ones)), n / (2 * ones)) if 0 < ones < n else (1.0, 1.0)
        factors[f] = pair if not rule.boosted and rule.balanced else (1.0, 1.0)
        sizes[f] = n
    batches, lower = [], []

    def keep(state: Growing) -> None:
        for job, f in enumerate(state.folds):
            nodes = state.nodes(job)
            known = nodes["feature"] > -3  # the rest is in `lower`
            nodes = {c: v[known] for c, v in nodes.items()}
            batches.append(model_batch(np.full(len(nodes["heap"]), f), nodes, edges))

    if not rule.boosted:
        jobs = [(f, t) for t in range(rule.trees) for f in folds]
        for first in range(0, len(jobs), 256):
            state = Growing(jobs[first : first + 256], rule.depth, sizes, alone)
            _grow_upper(blocks, state, rule, width, factors, lambda block: block.margin)
            if (state.feature == -3).any():
                below = subtrees(blocks, state, rule, edges, factors, lambda block: block.margin)
                lower.append(stage(below.select("fold", "tree", F.col("at").alias("heap"), "feature", "threshold", "value")))
            keep(state)
    else:
        recent: list[Growing] = []

        def margins(block: Block, done: list[Growing]) -> np.ndarray:
            out = block.margin.copy()
            for state in done:
                for job in range(len(state.folds)):
                    out[job] += routed(block.codes, state.nodes(job))
            return out

        for k in range(rule.trees):
            state, done = Growing([(f, k) for f in folds], rule.depth, sizes, alone), list(recent)
            own = lambda block, done=done: margins(block, done)
            _grow_upper(blocks, state, rule, width, factors, own)
            if (state.feature == -3).any():
                found = subtrees(blocks, state, rule, edges, factors, own).select("job", "at", "feature", "code", "value").collect()
                state.feature[state.feature == -3] = -1  # nodes that no row has come to
                for place, at, feature, code, value in found:  # at most 2**(depth+1) nodes a fold
                    state.feature[place, at], state.code[place, at], state.value[place, at] = feature, code, value
            keep(state)
            recent.append(state)
            if len(recent) == RESTAGE and k + 1 < rule.trees:
                done, recent = list(recent), []

                def moved(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        for row in batch.to_pylist():
                            block = Block.read(row)
                            block.margin = margins(block, done)
                            yield record_batch([block.row()], PACKED_TYPES)

                blocks = stage(blocks.mapInArrow(moved, PACKED))
    upper = spark.createDataFrame(pa.Table.from_batches(batches), MODEL)
    return stage(reduce(DataFrame.unionByName, lower, upper))


def fold_counts(blocks: DataFrame) -> dict[int, tuple[int, float]]:
    """(rows, ones) of every fold number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                fold, index = np.unique(block.fold, return_inverse=True)
                columns = [pa.array(fold, pa.int32()), pa.array(np.bincount(index), pa.int64()), pa.array(np.bincount(index, block.y), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["fold", "n", "ones"])

    found = blocks.mapInArrow(run, "fold int, n long, ones double").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    return {row.fold: (row.n, row.ones) for row in found.collect()}


# --- training and prediction -------------------------------------------------------------------


def train(rows: DataFrame, positive, folds: list[int], rule: Impurity | Boosting, local_bytes: int | None = None, subtree_rows: int | None = None) -> DataFrame:
    """One model per fold from rows(row_id, label, x, fold): (fold, tree, heap, feature, threshold, value).

    A row goes left where its feature is at most the threshold. Fold numbers that are not listed train every model.
    Beyond ``local_bytes``, subtrees of at most ``subtree_rows`` rows are grown in one task each. Boosted trees of so few
    rows, of which one task would grow every whole tree, stay in the task of their fold from one to the next.
    """
    edges = bin_edges(rows)
    n = rows.count()
    bound = LOCAL_BYTES if local_bytes is None else local_bytes
    kept = rule.boosted and local_bytes is None and n <= (SUBTREE_ROWS if subtree_rows is None else subtree_rows)
    if kept or n * (len(edges) + 8 * (3 + len(folds))) <= bound:
        blocks = stage(packed(rows.repartition(1), positive, edges, 0, max(1, n)))
        return _local(blocks, folds, rule, edges, n)
    alone = SUBTREE_ROWS if subtree_rows is None else subtree_rows
    return _distributed(stage(packed(rows, positive, edges, len(folds), BLOCK_ROWS)), folds, rule, edges, alone)


class Forest:
    """All trees of one fold as flat arrays."""

    def __init__(self, tree: np.ndarray, heap: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        order = np.lexsort((heap, tree))
        ids = (tree.astype(np.int64) * HEAPS + heap)[order]
        self.feature, self.threshold, self.value = feature[order], threshold[order], value[order]
        self.left = np.searchsorted(ids, ids // HEAPS * HEAPS + 2 * (ids % HEAPS))
        self.roots = np.flatnonzero(ids % HEAPS == 1)
        self.trees = tree[order][self.roots]

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) values."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        while True:
            rows, trees = np.nonzero(self.feature[at] >= 0)
            if not len(rows):
                return self.value[at]
            here = at[rows, trees]
            at[rows, trees] = self.left[here] + (x[rows, self.feature[here]] > self.threshold[here])


def predict(model: DataFrame, rows: DataFrame, boosted: bool = False) -> DataFrame:
    """(row_id, label, fold, score): every row scored by the model of its fold; rows of other folds are left out.

    The score is the probability of the positive class: the trees' mean, or the logistic of their sum.
    """
    folds = sorted(row.fold for row in model.select("fold").distinct().collect())
    kinds = rows.schema
    schema = f"row_id {kinds['row_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, fold int, score double"
    forests = [(f, shared_forest(model, f)) for f in folds]

    def scoring(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = unpacked(shared.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                score = np.zeros(batch.num_rows)
                for part in np.array_split(np.arange(batch.num_rows), -(-batch.num_rows * max(1, len(forest.roots)) // ENTRIES)):
                    v = forest.values(x[part])
                    score[part] = 1 / (1 + np.exp(-v.sum(axis=1))) if boosted else v.mean(axis=1)
                out = [batch.column("row_id"), batch.column("label"), batch.column("fold"), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, ["row_id", "label", "fold", "score"])

        return run

    slim = rows.select("row_id", "label", F.col("fold").cast("int").alias("fold"), "x")
    each = [slim.filter(F.col("fold") == f).mapInArrow(scoring(shared), schema) for f, shared in forests]
    return reduce(DataFrame.unionByName, each) if each else slim.limit(0).select("row_id", "label", "fold", F.lit(0.0).alias("score"))


PACK_TREES = 64
NODE = {"tree": np.int32, "heap": np.int16, "feature": np.int16, "threshold": np.float64, "value": np.float64}


def shared_forest(model: DataFrame, fold: int):
    """The trees of one fold as a broadcast list of packed arrays, packed ``PACK_TREES`` trees at a time in tasks."""

    def pack(table: pa.Table) -> pa.Table:
        filled = {c: table.column(c).to_numpy().astype(t) for c, t in NODE.items()}  # the threshold of a leaf is NaN
        return pa.table({c: pa.array([v.tobytes()], pa.binary()) for c, v in filled.items()})

    some = model.filter(F.col("fold") == fold).groupBy(F.floor(F.col("tree") / PACK_TREES))
    found = some.applyInArrow(pack, ", ".join(f"{c} binary" for c in NODE)).collect()
    return model.sparkSession.sparkContext.broadcast([tuple(bytes(v) for v in row) for row in found])


def unpacked(parts: list[tuple[bytes, ...]]) -> Forest:
    return Forest(*(np.frombuffer(b"".join(p[k] for p in parts), dtype=t) for k, t in enumerate(NODE.values())))


def out_of_bag(model: DataFrame, rows: DataFrame, rule: Impurity, fold: int) -> DataFrame:
    """(row_id, label, score, trees): training rows scored by the trees whose bag does not hold them; null without any."""
    shared = shared_forest(model, fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = unpacked(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            left_out = rule.weights(batch.column("key").to_numpy()[:, None], forest.trees[None, :]) == 0
            n = left_out.sum(axis=1)
            score = (forest.values(x) * left_out).sum(axis=1) / np.maximum(n, 1)
            values = pa.array(score, pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("label"), values, pa.array(n, pa.int64())], ["row_id", "label", "score", "trees"])

    kinds = rows.schema
    schema = f"row_id {kinds['row_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, score double, trees long"
    own = rows.filter(F.col("fold") != fold).select("row_id", "label", "x", F.xxhash64("row_id").alias("key"))
    return own.mapInArrow(run, schema)


def rule_of(name: str, width: int, trees: int | None = None, rounds: int | None = None, seed: int = 42) -> Impurity | Boosting:
    """The published settings of a tree model."""
    if name == "decision_tree":
        return Impurity(depth=10, min_split=10, min_leaf=5, seed=seed)
    if name == "random_forest":
        some = max(1, int(np.sqrt(width)))
        return Impurity(trees=trees or 500, depth=10, min_split=5, min_leaf=2, features=some, bagged=True, seed=seed)
    if name == "xgboost":
        return Boosting(trees=rounds or 300, seed=seed)
    raise ValueError(f"no tree model {name}")
