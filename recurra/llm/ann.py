"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and is small; every row is then filed under a leaf. A query walks the tree
with a priority queue of nodes, most promising centre first, and visits leaves in that order. How many is
calibrated: as many as a set of queries needs to find enough of its true neighbours, which are known from a scan.

Leaves that stand together in the tree form zones of bounded size, a large leaf's rows are dealt into several. Visits
are made in rounds, each to a few times as many leaves as all before. The k-th score so far is a floor: a leaf whose
ball (centre, largest distance of its rows) cannot reach it is not visited, and rows below it are not reported. So a
query reports a few times k rows a round, however many leaves there are, and zones that no query needs are not copied.
Scores are summed in a fixed order, so equal vectors have equal scores wherever they stand and ties go to the smaller id.

* At least k rows besides the own one are seen by every query, or all there are.
* Rows whose id or vector is null, whose vector is zero, or holds a null or non-finite component, take no part; nor do
  vectors of another length than most. Repeated rows are candidates of their own. Empty tables give empty results.
* Leaves are at most MOST_LEAVES; beyond LEAF_ROWS times as many rows they grow in proportion. Only the named columns
  are read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SAMPLE = 20_000  # most rows that the tree is fitted on
CALIBRATION = 200  # most queries whose true neighbours are looked up to choose the number of visits
LEAF_ROWS, MOST_LEAVES, BRANCH = 48, 1024, 16
BLOCK = 4096  # most rows of a zone's part, most queries of a block
FIRST, GROWTH = 8, 8  # leaves of the first round, and how much further each next one goes
TARGET = 0.95
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v as doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of at most k non-empty clusters."""
    centres = np.unique(points[rng.choice(len(points), min(k, len(points)), replace=False)], axis=0)
    for _ in range(rounds):
        own = nearest(points, centres)
        used = np.unique(own)
        centres = np.stack([points[own == c].mean(axis=0) for c in used])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)


class Tree:
    """Nodes by number: centres of their children, the children's numbers, and the leaf that a childless one is."""

    def __init__(self, centres=(), children=(), leaf=()):
        self.centres: list[np.ndarray] = list(centres)
        self.children: list[list[int]] = list(children)
        self.leaf: list[int] = list(leaf)
        self.leaves = max(self.leaf, default=-1) + 1

    def grow(self, points: np.ndarray, leaf_points: int, branch: int = BRANCH, seed: int = 3) -> tuple:
        """Fit an empty tree; what it is made of, for Tree(*parts)."""
        self._grow(points, leaf_points, branch, np.random.default_rng(seed), 0)
        return self.centres, self.children, self.leaf

    def _grow(self, points: np.ndarray, leaf_points: int, branch: int, rng: np.random.Generator, depth: int) -> int:
        node = len(self.leaf)
        self.centres.append(np.zeros((0, points.shape[1])))
        self.children.append([])
        self.leaf.append(-1)
        if len(points) > leaf_points and depth < 10:
            wanted = min(branch, max(2, -(-len(points) // leaf_points)))
            centres = kmeans(points, wanted, rng)
            if len(centres) > 1:
                own = nearest(points, centres)
                self.centres[node] = centres
                self.children[node] = [
                    self._grow(points[own == c], leaf_points, branch, rng, depth + 1) for c in range(len(centres))
                ]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def file(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest centre on every level."""
        out = np.zeros(len(points), dtype=np.int32)
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = nearest(points[rows], self.centres[node])
            open_nodes += [(child, rows[own == c]) for c, child in enumerate(self.children[node])]
        return out

    def leaf_centres(self, width: int) -> np.ndarray:
        out = np.zeros((self.leaves, width))
        for node, children in enumerate(self.children):
            for centre, child in zip(self.centres[node], children):
                if self.leaf[child] >= 0:
                    out[self.leaf[child]] = centre
        return out

    def visits(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first leaves in the order of a best-bin-first walk: `most`, or more until they hold `rows` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < rows):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += 0 if sizes is None else int(sizes[self.leaf[node]])
                continue
            for worth, child in zip(self.centres[node] @ query, self.children[node]):
                heapq.heappush(queue, (-float(worth), child))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def top(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray | float = -np.inf
) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of the k best candidates of each query, its own row left out.

    Candidates clearly below the floor, the query's k-th score so far, cannot be among its nearest and are left out.
    """
    rough = q @ v.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    least = np.broadcast_to(np.asarray(floor, dtype=float), (len(q),))
    if len(v) > k:
        least = np.maximum(least, np.partition(rough, len(v) - k, axis=1)[:, len(v) - k])
    margin = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0))
    rows, columns = np.nonzero((rough >= (least - margin)[:, None]) & (rough > -np.inf))
    score = np.zeros(len(rows))
    for d in range(q.shape[1]):
        score += q[rows, d] * v[columns, d]
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - first[rows] < k
    return q_ids[rows[keep]], ids[columns[keep]], score[keep]


def fit(rows: DataFrame, leaf_share: float, sample: int = SAMPLE) -> Tree:
    """A tree over at most `sample` rows, chosen by a hash of their id; a leaf holds about leaf_share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("vec_id").to_numpy(), matrix(b.column("v"))) for b in batches if b.num_rows]
        ids, points = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((*points.T[::-1], ids))
        parts = Tree().grow(points[order], max(4, int(len(points) * leaf_share)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], ["tree"])

    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    return Tree(*pickle.loads(bytes(chosen.repartition(1).mapInArrow(run, "tree binary").first().tree)))


def scan_neighbours(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, vec_id, score): true neighbours of a bounded list of queries, by a scan of all rows."""
    q_ids, q = np.array([i for i, _ in queries]), np.array([v for _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = top(q_ids, q, batch.column("vec_id").to_numpy(), matrix(batch.column("v")), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return best(rows.mapInArrow(run, FOUND), k).drop("rank")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def calibrate(filed: DataFrame, tree: Tree, is_query: Column, k: int, target: float) -> int:
    """The smallest number of leaf visits at which the calibration queries find the target share of their neighbours."""
    chosen = filed.filter(is_query).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION)
    queries = [(row.vec_id, list(row.v)) for row in chosen.select("vec_id", "v").collect()]
    if not queries:
        return 1
    truth = scan_neighbours(filed.select("vec_id", "v"), queries, k)
    leaves = truth.join(filed.select("vec_id", "leaf").distinct(), "vec_id").select("query_id", "leaf").collect()
    order = {i: {leaf: at for at, leaf in enumerate(tree.visits(np.array(v), tree.leaves))} for i, v in queries}
    ranks = np.array([order[row.query_id][row.leaf] for row in leaves])
    if not len(ranks):
        return 1
    return int(np.sort(ranks)[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1


def nearest_first(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of several searches, cut to the k best a query."""
    q, ids, score = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=int)
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(q)])))) < k
    return q[keep], ids[keep], score[keep]


def packed_zones(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The zone of each leaf, neighbours together up to BLOCK rows, and the parts that each zone's rows are dealt into."""
    zone, held = np.zeros(len(sizes), dtype=np.int64), 0
    for leaf, size in enumerate(sizes):
        new = leaf > 0 and held + size > BLOCK
        held = size if new else held + size
        zone[leaf] = zone[leaf - 1] + new if leaf else 0
    return zone, np.maximum(1, np.ceil(np.bincount(zone, sizes) / BLOCK)).astype(np.int64)


def neighbours(
    vectors: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE, target: float = TARGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == lengths[0].d)
    leaves = min(MOST_LEAVES, max(1, lengths[0].n // LEAF_ROWS))
    tree, width = fit(rows, 1 / leaves, sample), lengths[0].d
    parts_of_tree = spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaf))  # bounded by the sample

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*parts_of_tree.value)
        centres = tree.leaf_centres(width)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                leaf = tree.file(v)
                away = np.sqrt(((v - centres[leaf]) ** 2).sum(axis=1))
                yield batch.append_column("leaf", pa.array(leaf, pa.int32())).append_column("away", pa.array(away))

    is_query = F.col("vec_id") % every == 0
    filed = stage(rows.mapInArrow(file, "vec_id long, v array<double>, leaf int, away double"))
    visits = calibrate(filed, tree, is_query, k, target)

    # Sizes and radii of the leaves, at most MOST_LEAVES rows, and the zones that neighbouring leaves form.
    sizes, radii, asks = np.zeros(tree.leaves, dtype=np.int64), np.zeros(tree.leaves), np.zeros(tree.leaves, dtype=np.int64)
    stats = filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.sum(is_query.cast("long")).alias("q"))
    for row in stats.collect():
        sizes[row.leaf], radii[row.leaf], asks[row.leaf] = row.n, row.r, row.q
    zone, row_parts = packed_zones(sizes)
    ask_zone, ask_parts = packed_zones(asks)
    layout = spark.sparkContext.broadcast((sizes, radii, zone, row_parts))  # a few numbers a leaf

    def at(values: np.ndarray, position: Column) -> Column:
        return F.get(F.array(*[F.lit(int(v)) for v in values]), position)

    def dealt(parts: np.ndarray, position: Column) -> Column:
        return F.pmod(F.xxhash64("vec_id"), at(parts, position).cast("long")).cast("int")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (sizes, *_) = Tree(*parts_of_tree.value), layout.value
        for batch in batches:
            if batch.num_rows:
                seen = [tree.visits(v, visits, sizes, k + 1) for v in matrix(batch.column("v"))]
                yield batch.append_column("leaves", pa.array(seen, pa.list_(pa.int32())))

    filed = filed.drop("away").withColumn("zone", at(zone, F.col("leaf"))).withColumn("ask_zone", at(ask_zone, F.col("leaf")))
    asked = filed.filter(is_query).select("vec_id", "v", "ask_zone").distinct()
    block = F.col("ask_zone").cast("long") * (1 << 20) + dealt(ask_parts, F.col("ask_zone"))
    asked = stage(asked.select("vec_id", "v", block.alias("query_block")).mapInArrow(walk, "vec_id long, v array<double>, query_block long, leaves array<int>"))
    placed = filed.select("vec_id", "v", "leaf", "zone", dealt(row_parts, F.col("zone")).alias("part"))
    longest = asked.agg(F.max(F.size("leaves"))).first()[0] or 0

    def searched(asked: DataFrame, first: int, last: int) -> DataFrame:
        """What the visits `first` to `last` find: each query's leaves of one zone are searched together."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, (_, radii, zone, row_parts) = Tree(*parts_of_tree.value), layout.value
            centres = tree.leaf_centres(width)
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, floor = matrix(batch.column("v")), batch.column("floor").to_numpy()
                own, zones, parts, lists = [], [], [], []
                for i, leaves in enumerate(batch.column("leaves").to_pylist()):
                    leaves = np.array(leaves[first:last], dtype=np.int64)
                    length = np.linalg.norm(q[i])
                    reach = centres[leaves] @ q[i] + length * radii[leaves]
                    leaves = leaves[reach * (1 + 1e-9) + 1e-9 * length >= floor[i]]
                    for z in np.unique(zone[leaves]):
                        inside = leaves[zone[leaves] == z].tolist()
                        for part in range(row_parts[z]):
                            own.append(i)
                            zones.append(z)
                            parts.append(part)
                            lists.append(inside)
                out = batch.select(["vec_id", "v", "floor", "query_block"]).take(pa.array(own, pa.int64()))
                for name, values, kind in (("zone", zones, pa.int32()), ("part", parts, pa.int32()), ("leaves", lists, pa.list_(pa.int32()))):
                    out = out.append_column(name, pa.array(values, kind))
                yield out

        def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
            found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
            if asked.num_rows and rows.num_rows:
                q, v = (matrix(t.column("v").combine_chunks()) for t in (asked, rows))
                q_ids, ids = asked.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
                floor, leaf = asked.column("floor").to_numpy().copy(), rows.column("leaf").to_numpy()
                lists = asked.column("leaves").combine_chunks()
                who = np.repeat(np.arange(asked.num_rows), np.diff(lists.offsets.to_numpy()))
                wanted = lists.flatten().to_numpy()
                for one in np.unique(leaf):
                    mine, own = who[wanted == one], np.flatnonzero(leaf == one)
                    if len(mine):
                        found.append(top(q_ids[mine], q[mine], ids[own], v[own], k, floor[mine]))
                        if len(found) > 32:
                            found = [nearest_first(found, k)]
            return pa.table([pa.array(x) for x in nearest_first(found, k)], names=["query_id", "vec_id", "score"])

        sent = stage(asked.mapInArrow(send, "vec_id long, v array<double>, floor double, query_block long, zone int, part int, leaves array<int>"))
        cells = stage(sent.select("zone", "query_block").distinct())
        cell = ("zone", "part", "query_block")
        return sent.groupBy(*cell).cogroup(placed.join(cells, "zone").groupBy(*cell)).applyInArrow(search, FOUND)

    # Each round's k-th scores are the floors of the next.
    none = F.lit(float("-inf"))
    near, first, last = None, 0, FIRST
    while near is None or first < longest:
        if near is None:
            open_queries = asked.withColumn("floor", none)
        else:
            floors = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            open_queries = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
        found = searched(open_queries, first, last)
        near = stage(best(found if near is None else near.drop("rank").unionByName(found), k))
        first, last = last, last * GROWTH
    return near
