"""Embedding parameters: lag curves, delay choice, false nearest neighbours, dimension choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entropy_term, lerp
from ..session import stage
from .blocks import BLOCK, HELD, STRIP, map_rows, signal_blocks
from .chunks import chunk_with_halo, dealt, more_tasks
from .leaves import nearest

BINS = 10
NEIGHBOR_BLOCK = 2 * BLOCK
NEIGHBOR_SIDE, WIDEST = 20, 1 << 17  # row blocks of a series before they grow, and the most samples of one; the blocks they meet hold twice as many
WHOLE_PAIRS = NEIGHBOR_BLOCK * NEIGHBOR_BLOCK  # pairs of two blocks that are all compared


def min_length(signal: DataFrame, tau_max: int = 100, dim_max: int = 10) -> DataFrame:
    """Keep signals long enough for the largest embedding tried."""
    return signal.filter(F.col("n") >= (dim_max - 1) * tau_max + 1)


def extent(signal: DataFrame) -> DataFrame:
    """(signal_id, lo, hi, mu, sd): minimum, maximum, mean and population deviation of every signal."""
    return signal.groupBy("signal_id").agg(
        F.min("y").alias("lo"),
        F.max("y").alias("hi"),
        F.avg("y").alias("mu"),
        F.stddev_pop("y").alias("sd"),
    )


def with_span(signal: DataFrame) -> DataFrame:
    """Attach the signal's minimum, maximum, mean and population deviation."""
    return signal.join(extent(signal), "signal_id")


def spanned_blocks(signal: DataFrame, size: int, after: int, tasks: int | None) -> DataFrame:
    """Blocks of a signal with the minimum, maximum and mean of their series.

    A series of one block has them in its samples; those of the others, at most one row for ``size`` samples, are joined.
    """
    span = extent(signal.filter(F.col("n") > size)).select("signal_id", *[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "mu")])
    blocks = signal_blocks(signal, size, after=after, tasks=tasks).filter("signal_id is not null")
    blocks = blocks.join(F.broadcast(span), "signal_id", "left")
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v)
    own = {"lo": F.array_min("y"), "hi": F.array_max("y"), "mu": total / F.size("y")}
    return blocks.select("signal_id", "b", "n", "y", *[F.when(F.col("n") > size, F.col(f"_{c}")).otherwise(v).alias(c) for c, v in own.items()])


def _code(y: Column, bins: int) -> Column:
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    inner = sum(((y >= F.col("lo") + step * F.lit(float(k))).cast("int") for k in range(1, bins)), F.lit(0))
    return F.when(y >= F.col("hi"), F.lit(bins)).otherwise(inner)


def bin_codes(signal: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width codes 0..bins-1; the maximum alone gets code ``bins``."""
    return with_span(signal).select("signal_id", "i", "n", "y", _code(F.col("y"), bins).alias("code"))


def series_entropy(codes: DataFrame, bins: int = BINS) -> DataFrame:
    """Entropy in nats of the whole series; the top two codes share the last histogram bin."""
    counts = codes.groupBy("signal_id", F.least("code", F.lit(bins - 1)).alias("code")).agg(
        F.count(F.lit(1)).alias("c"), F.first("n").alias("n")
    )
    return counts.groupBy("signal_id").agg(
        F.sum(entropy_term(F.col("c") / F.col("n"), "e")).alias("h")
    )


def _lag_tables(row, tau_max: int, size: int, width: int):
    """(lag, counts of code pairs) of the samples that a block owns; codes are below ``width``."""
    code = np.asarray(row.y, dtype=np.int64)
    own = min(size, row.n - row.b * size)
    for lag in range(0, tau_max + 1):
        later = code[lag : lag + own]
        if not len(later):
            break
        yield lag, np.bincount(code[: len(later)] * width + later, minlength=width * width)


def _code_blocks(codes: DataFrame, tau_max: int, size: int) -> DataFrame:
    return signal_blocks(codes.select("signal_id", "i", "n", F.col("code").alias("y")), size, after=tau_max)


def lagged_counts(codes: DataFrame, tau_max: int, bins: int = BINS, size: int = 16 * BLOCK) -> DataFrame:
    """Joint code counts of (series, series shifted by lag), lag 0 included: (signal_id, lag, x, y, c).

    Each block counts its own pairs with ``tau_max`` samples of halo; only the small tables of
    counts are shuffled.
    """
    return (
        map_rows(_code_blocks(codes, tau_max, size), "signal_id", CELLS, lambda row: _cells(row, tau_max, size, bins + 1))
        .groupBy("signal_id", "lag", "x", "y")
        .agg(F.sum("c").alias("c"))
    )


CELLS = "lag int, x int, y int, c long"


def _cells(row, tau_max: int, size: int, width: int) -> dict | None:
    lags, xs, ys, counts = [], [], [], []
    for lag, table in _lag_tables(row, tau_max, size, width):
        used = np.flatnonzero(table)
        lags.append(np.full(len(used), lag))
        xs.append(used // width)
        ys.append(used % width)
        counts.append(table[used])
    if not lags:
        return None
    return {
        "lag": np.concatenate(lags),
        "x": np.concatenate(xs),
        "y": np.concatenate(ys),
        "c": np.concatenate(counts),
    }


def mutual_information(signal: DataFrame, tau_max: int = 100, bins: int = BINS, size: int = 16 * BLOCK) -> DataFrame:
    """MI(lag) = H(X) + H(Y) - H(X,Y) in nats: (signal_id, lag, value).

    H(X) is that of the full series: the joint entropy at lag 0. A series of one block has all its counts in one place
    and is finished there; the counts of longer ones meet cell by cell.
    """
    width, tasks = bins + 1, more_tasks(signal, signal.count())

    def coded(part: DataFrame) -> DataFrame:
        return spanned_blocks(part, size, tau_max, tasks).withColumn("y", F.transform("y", lambda v: _code(v, bins)))

    def kernel(row):
        out = {name: [] for name in ("lag", "cells", "margin", "zero")}
        for lag, table in _lag_tables(row, tau_max, size, width):
            table = table.reshape(width, width)
            for turned in (table, table.T):  # the same rule as merged()
                if turned[0].any() and turned[bins].any():
                    turned[bins - 1] += turned[bins]
                    turned[bins] = 0
            margin = table.sum(axis=0)
            cells = table[table > 0]
            for name, value in zip(out, (lag, cells, margin[margin > 0], out["zero"][0] if lag else cells)):
                out[name].append(value)
        return out

    # sum -(c/t) log(c/t) = log t - (1/t) sum c log c, for the cells and for the y marginal alike
    def nats(total: str, logs: str) -> Column:
        return F.log(total) - F.col(logs) / F.col(total)

    logs = "aggregate({}, 0D, (a, c) -> a + CAST(c AS DOUBLE) * ln(CAST(c AS DOUBLE)))"
    added = {"t": "aggregate(margin, 0D, (a, c) -> a + c)", "t0": "aggregate(zero, 0D, (a, c) -> a + c)"}
    added |= {"s_xy": logs.format("cells"), "s_y": logs.format("margin"), "s_0": logs.format("zero")}
    alone = (
        map_rows(coded(signal.filter(F.col("n") <= size)), "signal_id", "lag int, cells array<long>, margin array<long>, zero array<long>", kernel)
        .filter("lag > 0")
        .select("signal_id", "lag", *[F.expr(e).alias(name) for name, e in added.items()])
        .select("signal_id", "lag", (nats("t0", "s_0") + nats("t", "s_y") - nats("t", "s_xy")).alias("value"))
    )

    parts = map_rows(coded(signal.filter(F.col("n") > size)), "signal_id", CELLS, lambda row: _cells(row, tau_max, size, width))
    joint = parts.groupBy("signal_id", "lag", "x", "y").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("signal_id", "lag")

    def merged(col):
        """The top two codes fall together only when the codes span the whole range."""
        full = (F.min(col).over(w) == 0) & (F.max(col).over(w) == bins)
        return F.when(full, F.least(F.col(col), F.lit(bins - 1))).otherwise(F.col(col))

    cells = joint.select("signal_id", "lag", merged("x").alias("x"), merged("y").alias("y"), "c")
    both = cells.groupBy("signal_id", "lag", "y", "x").agg(F.sum("c").alias("c"))
    c = F.col("c").cast("double")
    curves = (
        both.groupBy("signal_id", "lag", "y")
        .agg(F.sum(c).alias("cy"), F.sum(c * F.log(c)).alias("s_xy"))
        .groupBy("signal_id", "lag")
        .agg(F.sum("cy").alias("t"), F.sum("s_xy").alias("s_xy"), F.sum(F.col("cy") * F.log("cy")).alias("s_y"))
        .select("signal_id", "lag", nats("t", "s_y").alias("hy"), nats("t", "s_xy").alias("hxy"))
    )
    entropy = F.max(F.when(F.col("lag") == 0, F.col("hxy"))).over(Window.partitionBy("signal_id"))
    longer = (
        curves.withColumn("h", entropy)
        .filter("lag > 0")
        .select("signal_id", "lag", (F.col("h") + F.col("hy") - F.col("hxy")).alias("value"))
    )
    return dealt(alone.unionByName(longer), tasks, "signal_id")


def autocorrelation(signal: DataFrame, tau_max: int = 100, size: int = 16 * BLOCK) -> DataFrame:
    """ACF(lag) about the global mean, normalised by lag 0: (signal_id, lag, value).

    A constant series gives zeros; its curve has one lag more than the others.
    """

    def kernel(row):
        y = np.asarray(row.y)
        own = min(size, row.n - row.b * size)
        lags = np.arange(0, tau_max + 2)
        sums = np.array([float(np.dot(y[: len(z)], z)) for z in (y[k : k + own] for k in lags)])
        return {"lag": lags, "v": sums, "n": np.full(len(lags), row.n)}

    def level(y: Column) -> Column:
        return F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(y - F.col("mu"))

    tasks = more_tasks(signal, signal.count())
    centred = spanned_blocks(signal, size, tau_max + 1, tasks).withColumn("y", F.transform("y", level))
    sums = (
        dealt(map_rows(centred, "signal_id", "lag int, v double, n long", kernel), tasks, "signal_id")
        .groupBy("signal_id", "lag")
        .agg(F.sum("v").alias("v"), F.first("n").alias("n"))
    )
    whole = F.max(F.when(F.col("lag") == 0, F.col("v"))).over(Window.partitionBy("signal_id"))
    constant = F.col("whole") == 0
    return (
        sums.withColumn("whole", whole)
        .filter((F.col("lag") >= 1) & ((F.col("lag") <= tau_max) | constant))
        .filter(constant | (F.col("lag") < F.col("n")))
        .select(
            "signal_id",
            "lag",
            F.when(constant, F.lit(0.0)).otherwise(F.col("v") / F.col("whole")).alias("value"),
        )
    )


def first_local_minimum(curve: DataFrame) -> DataFrame:
    """Lag of the first strict two-sided minimum, else of the first global minimum."""
    w = Window.partitionBy("signal_id").orderBy("lag")
    dip = (F.col("value") < F.lag("value").over(w)) & (F.col("value") < F.lead("value").over(w))
    return (
        curve.withColumn("dip", F.when(dip, F.col("lag")))
        .groupBy("signal_id")
        .agg(
            F.coalesce(F.min("dip"), F.min(F.struct("value", "lag"))["lag"]).cast("int").alias("tau")
        )
    )


def first_zero_crossing(curve: DataFrame) -> DataFrame:
    """Last lag before the first sign change; NULL if the sign never changes."""
    w = Window.partitionBy("signal_id").orderBy("lag")
    change = F.signum("value") != F.lead(F.signum("value")).over(w)
    return (
        curve.withColumn("hit", F.when(change, F.col("lag")))
        .groupBy("signal_id")
        .agg(F.min("hit").cast("int").alias("tau"))
    )


def choose_delay(mi: DataFrame, acf: DataFrame) -> DataFrame:
    """(signal_id, tau_mi, tau_acf, tau): the first available of the two, else 1."""
    left = first_local_minimum(mi).withColumnRenamed("tau", "tau_mi")
    right = first_zero_crossing(acf).withColumnRenamed("tau", "tau_acf")
    return left.join(right, "signal_id", "full").withColumn(
        "tau", F.coalesce("tau_mi", "tau_acf", F.lit(1))
    )


def takens(signal: DataFrame, m: int, tau: int, size: int = BLOCK) -> DataFrame:
    """Delay vectors as rows: (signal_id, i, x0..x{m-1}), one per start that fits."""
    reach = (m - 1) * tau
    w = Window.partitionBy("signal_id", "b").orderBy("i")
    coords = [F.lead("y", k * tau).over(w).alias(f"x{k}") for k in range(m)]
    return (
        chunk_with_halo(signal, "i", size, after=reach)
        .select("signal_id", "i", "n", "own", *coords)
        .filter(F.col("own") & (F.col("i") < F.col("n") - reach))
        .drop("own", "n")
    )


def _row_minimum(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index of the smallest root per row, without taking all roots.

    Squares a rounding step apart can share a root, so rows with such a rival are looked at again.
    """
    best = square.argmin(axis=1)
    low = square[np.arange(len(best)), best]
    first = (square <= (low * (1 + 1e-15))[:, None]).argmax(axis=1)
    for k in np.flatnonzero(first != best):
        best[k] = np.flatnonzero(np.sqrt(square[k]) == np.sqrt(low[k]))[0]
    return best, np.sqrt(low)


class _RowBlock:
    """The best neighbours so far of a block of a series, which meets the blocks of the same series one by one."""

    def __init__(self, row, dim_max: int, size: int):
        self.y, self.n, self.tau, self.dims = np.asarray(row.y), row.n, int(row.tau), dim_max
        self.lo, self.key = row.b * size, row.signal_id
        counts = [min(size, row.n - (d - 1) * self.tau - self.lo) for d in range(1, dim_max + 1)]
        self.counts = [max(0, c) for c in counts]
        self.dist = [np.full(c, np.inf) for c in self.counts]
        self.best = [np.full(c, -1, dtype=np.int64) for c in self.counts]
        self.step = [np.full(c, np.nan) for c in self.counts]

    def meet(self, y: np.ndarray, lo: int, size: int) -> None:
        later = [max(0, min(size, self.n - d * self.tau - lo)) for d in range(self.dims + 1)]
        if self.counts[0] * later[0] <= WHOLE_PAIRS:
            self.compare(y, lo, later)
        else:
            self.search(y, lo, later)

    def keep(self, d: int, rows: np.ndarray, dist: np.ndarray, best: np.ndarray, y: np.ndarray, lo: int, later: list[int]) -> None:
        """Take what is nearer, or as near with a lower index: rows of the block, indices within the other one."""
        old, j = self.dist[d - 1][rows], lo + best
        with np.errstate(invalid="ignore"):
            better = np.isfinite(dist) & ((dist < old) | ((dist == old) & (j < self.best[d - 1][rows])))
        rows, best, dist = rows[better], best[better], dist[better]
        step, shift = np.full(len(rows), np.nan), d * self.tau
        both = np.flatnonzero((best < later[d]) & (self.lo + rows < self.n - shift))
        step[both] = self.y[rows[both] + shift] - y[best[both] + shift]
        self.dist[d - 1][rows], self.best[d - 1][rows], self.step[d - 1][rows] = dist, lo + best, step

    def compare(self, y: np.ndarray, lo: int, later: list[int]) -> None:
        """All pairs of two small blocks."""
        for top in range(0, self.counts[0], STRIP):
            square = np.zeros((STRIP, later[0]))
            work = np.empty_like(square)
            for d in range(1, self.dims + 1):
                na, nb = min(STRIP, self.counts[d - 1] - top), later[d - 1]
                if na <= 0 or nb <= 0:
                    break
                shift = (d - 1) * self.tau
                square, work = square[:na, :nb], work[:na, :nb]
                start = top + shift
                np.subtract(self.y[start : start + na, None], y[shift : shift + nb], out=work)
                np.multiply(work, work, out=work)
                square += work
                own = self.lo + top + np.arange(na) - lo
                keep = (own >= 0) & (own < nb)
                square[keep, own[keep]] = np.inf
                best, dist = _row_minimum(square)
                self.keep(d, top + np.arange(na), dist, best, y, lo, later)

    def search(self, y: np.ndarray, lo: int, later: list[int]) -> None:
        """Equal vectors are found by sorting, the nearest of the others in boxes of near vectors."""
        values, code = np.unique(np.concatenate([self.y, y]), return_inverse=True)
        ours, theirs = code[: len(self.y)], code[len(self.y) :]
        usable = np.isfinite(values)
        a = b = np.zeros(0, dtype=np.int64)
        sound_a = sound_b = np.zeros(0, dtype=bool)
        for d in range(1, self.dims + 1):
            na, nb, shift = self.counts[d - 1], later[d - 1], (d - 1) * self.tau
            if na <= 0 or nb <= 0:
                break
            more_a, more_b = ours[shift : shift + na], theirs[shift : shift + nb]
            good_a, good_b = usable[more_a], usable[more_b]
            if d > 1:
                more_a, more_b = a[:na] * len(values) + more_a, b[:nb] * len(values) + more_b
                good_a, good_b = good_a & sound_a[:na], good_b & sound_b[:nb]
            code = np.unique(np.concatenate([more_a, more_b]), return_inverse=True)[1]
            a, b, sound_a, sound_b = code[:na], code[na:], good_a, good_b
            first, second = (np.full(int(code.max()) + 1, -1, dtype=np.int64) for _ in range(2))
            at = np.flatnonzero(sound_b)
            for place in (first, second):
                kinds, where = np.unique(b[at], return_index=True)
                place[kinds] = at[where]
                at = np.delete(at, where)
            equal = first[a]
            equal = np.where((equal >= 0) & (lo + equal == self.lo + np.arange(na)), second[a], equal)
            rows = np.flatnonzero((equal >= 0) & sound_a)
            self.keep(d, rows, np.zeros(len(rows)), equal[rows], y, lo, later)
            rows = np.flatnonzero((equal < 0) & sound_a & (self.dist[d - 1] > 0))
            q = first[first >= 0]
            if not len(rows) or not len(q):
                continue
            kinds, where, back = np.unique(a[rows], return_index=True, return_inverse=True)
            at, shifts = rows[where], np.arange(d) * self.tau
            number = np.full(len(first), -1, dtype=np.int64)
            number[first >= 0] = np.arange(len(q))
            dist, best = self.dist[d - 1][at].copy(), self.best[d - 1][at].copy()
            nearest(self.y[at[:, None] + shifts], y[q[:, None] + shifts], lo + q, number[kinds], dist, best)
            inside = (best >= lo) & (best < lo + nb)
            dist, best = np.where(inside, dist, np.inf), np.where(inside, best - lo, 0)
            self.keep(d, rows, dist[back], best[back], y, lo, later)

    def table(self) -> pd.DataFrame:
        parts = []
        for d in range(1, self.dims + 1):
            ok = np.flatnonzero(np.isfinite(self.dist[d - 1]))
            found = {"dist": self.dist, "j": self.best, "step": self.step}
            parts.append({"d": np.full(len(ok), d), "i": self.lo + ok} | {name: v[d - 1][ok] for name, v in found.items()})
        whole = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
        return pd.DataFrame({"signal_id": np.repeat(np.asarray([self.key], dtype=object), len(whole["d"]))} | whole)


def nearest_neighbors(
    signal: DataFrame, dim_max: int, tau: int, size: int | None = None, delays: DataFrame | None = None
) -> DataFrame:
    """Nearest other point of every delay vector for d = 1..dim_max, lowest index on ties.

    ``tau`` is the delay of every signal, or with ``delays`` (signal_id, tau) the largest of them.

    (signal_id, d, i, dist, j, step): ``step`` is the difference of the coordinate that dimension
    d+1 adds (NULL where either point has none). A block of rows stays in its task while the blocks of its series
    pass, its own surroundings first; nothing but the final neighbours leaves the task. Without ``size`` the blocks
    grow with the longest series, so that each is copied a bounded number of times.
    """
    spark, reach = signal.sparkSession, dim_max * tau
    longest = signal.agg(F.max("n")).first()[0] or 0 if size is None else 0
    rows = size or min(max(NEIGHBOR_BLOCK, -(-longest // NEIGHBOR_SIDE)), WIDEST)
    cols = size or rows * -(-2 * WIDEST // rows)
    blocks = signal_blocks(signal, rows, after=reach).filter("signal_id is not null")
    if delays is None:
        blocks = blocks.withColumn("tau", F.lit(tau))
    else:
        blocks = blocks.join(delays.select("signal_id", "tau"), "signal_id")
    last = (F.ceil(F.col("n") / rows) - 1).cast("long")
    none = F.lit(-1).cast("long")
    one = blocks.select("signal_id", "b", none.alias("bc"), none.alias("turn"), "n", F.col("tau").cast("int").alias("tau"), "y")
    other = signal_blocks(signal, cols, after=reach).filter("signal_id is not null")
    other = other.select(
        "signal_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("b"), F.col("b").alias("bc"),
        F.lit(None).cast("long").alias("turn"), "n", F.lit(None).cast("int").alias("tau"), "y",
    ).withColumn("turn", F.abs(F.floor(F.col("b") * rows / cols) - F.col("bc")))
    if delays is not None:
        other = other.join(delays.select("signal_id"), "signal_id", "left_semi")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-longest // rows), 4 * NEIGHBOR_SIDE))
    both = one.unionByName(other).repartition(tasks, "signal_id", "b").sortWithinPartitions("signal_id", "b", "turn", "bc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, parts, held = None, [], 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.bc >= 0:
                    mine.meet(np.asarray(row.y), row.bc * cols, cols)
                    continue
                if mine is not None:
                    parts.append(mine.table())
                    held += parts[-1].size
                    if held >= HELD:
                        yield pd.concat(parts, ignore_index=True)
                        parts, held = [], 0
                mine = _RowBlock(row, dim_max, rows)
        if mine is not None:
            yield pd.concat([*parts, mine.table()], ignore_index=True)

    key = signal.schema["signal_id"].dataType.simpleString()
    found = both.select("signal_id", "b", "bc", "n", "tau", "y").mapInPandas(
        run, f"signal_id {key}, d int, i long, dist double, j long, step double"
    )
    return found.withColumn("step", F.nanvl("step", F.lit(None)))


def false_neighbors(
    signal: DataFrame,
    dim_max: int = 10,
    tau: int = 1,
    r_tol: float = 15.0,
    a_tol: float = 2.0,
    size: int | None = None,
    delays: DataFrame | None = None,
) -> DataFrame:
    """FNN percentage per dimension: (signal_id, lag = d, value). 100 where nothing can be checked."""
    nearest = nearest_neighbors(signal, dim_max, tau, size, delays)
    spread = signal.groupBy("signal_id").agg(F.stddev_pop("y").alias("sd"))
    wider = F.sqrt(F.col("dist") * F.col("dist") + F.col("step") * F.col("step"))
    false = ((F.col("dist") > 0) & (wider / F.col("dist") > r_tol)) | (wider > a_tol * F.col("sd"))
    rates = (
        nearest.filter("step is not null")
        .join(spread, "signal_id")
        .groupBy("signal_id", "d")
        .agg((F.avg(false.cast("double")) * 100.0).alias("value"))
    )
    grid = spread.select("signal_id", F.explode(F.sequence(F.lit(1), F.lit(dim_max))).alias("d"))
    return grid.join(rates, ["signal_id", "d"], "left").select(
        "signal_id", F.col("d").alias("lag"), F.coalesce("value", F.lit(100.0)).alias("value")
    )


def choose_dimension(fnn: DataFrame, threshold: float = 5.0, dim_max: int = 10) -> DataFrame:
    """First dimension at or under the threshold, else the largest tried."""
    hit = F.min(F.when(F.col("value") <= threshold, F.col("lag")))
    return fnn.groupBy("signal_id").agg(F.coalesce(hit, F.lit(dim_max)).cast("int").alias("dim"))


def modes(df: DataFrame, group: str, value: str) -> DataFrame:
    """All most frequent non-null values per group: (group, mode, c)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("c")
    )
    best = Window.partitionBy(group)
    return counts.withColumn("_m", F.max("c").over(best)).filter("c = _m").select(
        group, F.col(value).alias("mode"), "c"
    )


def parameter_spread(records: DataFrame, columns=("tau_mi", "tau_acf", "dim_fnn")) -> DataFrame:
    """Five-number summary of every parameter: (parameter, n, least, q1, median, q3, most), missing values left out.

    Values are counted first, so what is ordered are the distinct values of a parameter, not its records.
    """
    long = records.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "parameter", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("parameter")
    upto = counts.withColumn("u", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    at = {name: (F.col("n") - 1) * p for name, p in shares.items()}
    picks = [
        F.min(F.when(F.col("u") > rank(at[name]), F.col("value"))).alias(f"{name}_{tag}")
        for name in shares for tag, rank in (("lo", F.floor), ("hi", F.ceil))
    ]
    found = upto.groupBy("parameter").agg(F.first("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), *picks)
    quartiles = [lerp(F.col(f"{name}_lo"), F.col(f"{name}_hi"), at[name] - F.floor(at[name])).alias(name) for name in shares]
    return found.select("parameter", "n", "least", *quartiles, "most")


def cumulative_coverage(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, share and running share of every value per class."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("c")
    )
    whole = Window.partitionBy(group)
    running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("c").over(whole)
    return counts.select(
        group,
        F.col(value).alias("value"),
        "c",
        (F.col("c") / total).alias("share"),
        (F.sum("c").over(running) / total).alias("coverage"),
    )


def stratified_sample(df: DataFrame, label: str, key: str, sizes: dict, seed: int = 0) -> DataFrame:
    """Exactly ``sizes[label]`` rows per class (all rows of smaller classes), chosen by hashed key.

    Each class is narrowed to a hash range that surely holds the sample before anything is
    ordered, so no task sorts a whole class.
    """
    spark_hash = F.xxhash64(F.col(key), F.lit(seed))
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col(label)]
    bucket = F.pmod(spark_hash, F.lit(4096))
    keyed = df.withColumn("_h", spark_hash).withColumn("_k", bucket).withColumn("_want", want)
    counts = keyed.groupBy(label, "_k").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inside = Window.partitionBy(label, "_k").orderBy("_h", key)
    return (
        keyed.join(before, [label, "_k"])
        .filter(F.col("_before") < F.col("_want"))
        .withColumn("_r", F.row_number().over(inside) + F.col("_before"))
        .filter(F.col("_r") <= F.col("_want"))
        .select(*df.columns)
    )


def parameter_records(signal: DataFrame, tau_max: int = 100, dim_max: int = 10) -> DataFrame:
    """(signal_id, tau_mi, tau_acf, dim_fnn), each signal searched at its own delay."""
    kept = min_length(signal, tau_max, dim_max)
    delays = stage(choose_delay(mutual_information(kept, tau_max), autocorrelation(kept, tau_max)))
    fnn = false_neighbors(kept, dim_max, tau_max, delays=delays)
    dims = choose_dimension(fnn, dim_max=dim_max)
    return delays.join(dims, "signal_id", "left").select(
        "signal_id", "tau_mi", "tau_acf", F.col("dim").alias("dim_fnn")
    )


def parameter_summary(records: DataFrame) -> DataFrame:
    """Mean and median of each parameter over the non-null records: (parameter, n, mean, median).

    Parameters are small integers, so the exact median comes from their counts.
    """
    names = [c for c in records.columns if c.startswith(("tau_", "dim_"))]
    counts = (
        records.select([F.col(c).cast("int") for c in names])
        .unpivot([], names, "parameter", "value")
        .filter("value is not null")
        .groupBy("parameter", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return counts.groupBy("parameter").agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"),
        F.expr("percentile(value, 0.5, c)").alias("median"),
    )


def needs_reprocessing(processed: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keys marked processed without a result, plus keys whose result has a NULL parameter."""
    holes = None
    for name in results.columns:
        if name != key:
            holes = F.col(name).isNull() if holes is None else holes | F.col(name).isNull()
    lost = processed.select(key).join(results, key, "left_anti")
    return lost.union(results.filter(holes).select(key)).distinct()
