"""Linear, kernel and network classifiers, trained for all folds of a cross-validation at once.

Rows are (row_id, label, x, fold); the model of a fold is trained on the rows of the other folds.

* Logistic regression: Newton steps on sums of first and second derivatives. One pass over the rows serves all folds;
  its result is (components + 1) squared numbers a fold, whatever the number of rows.
* RBF machine: the exact dual by pairwise coordinate steps, one task a fold. Of more than EXACT_ROWS training rows the
  steps are taken among WORKING_ROWS rows at a time, until no pair of all rows violates the conditions any more; the task
  holds the kernel of these rows and strips of it for the others. A caller may ask for Nystroem landmarks instead (their
  unexplained share of the kernel is measured and returned) and the same Newton steps on a hinge whose rounded corner is
  sharpened step by step.
* Perceptron: Adam on mini-batches of about 200 rows dealt by a hash of row and epoch, however many rows there are, L2
  penalty, early stopping on a held-out tenth. Each step needs the weights of the one before, so a fold is one task; beyond
  HELD_BYTES the task keeps its rows in a file.

Only models reach the driver: weights, support vectors or landmarks.
"""

from __future__ import annotations

import math
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .trees import class_factors, hashed, uniform

LOCAL_BYTES = 1 << 23  # Arrow batches of a task that are put together at a time
EXACT_ROWS, WORKING_ROWS = 4000, 1024  # most rows whose whole kernel a task holds; rows of a step beyond
KERNEL_STRIP, KERNEL_VALUES = 512, 1 << 22  # rows of a strip of the kernel; values of it when rows are scored
LANDMARKS = 512
HELD_OUT = 1 << 15  # held-out rows that are judged at a time
HELD_BYTES = 1 << 26  # vectors that a task holds in memory; of more it maps a file


@dataclass
class Rows:
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    key: np.ndarray

    def of(self, chosen: np.ndarray) -> Rows:
        return Rows(self.x[chosen], self.y[chosen], self.fold[chosen], self.key[chosen])


def coded_rows(rows: DataFrame, positive) -> DataFrame:
    """(x, y, fold, key): what training needs of a row."""
    y = (F.col("label") == positive).cast("double").alias("y")
    return rows.select("x", y, F.col("fold").cast("int").alias("fold"), F.xxhash64("row_id").alias("key"))


def rows_of(batches) -> Rows:
    """Record batches as arrays, in the order of the rows' hashes."""
    parts = []
    for b in batches:
        if b.num_rows:
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
            parts.append((flat.reshape(b.num_rows, -1), *(b.column(c).to_numpy() for c in ("y", "fold", "key"))))
    if not parts:
        return Rows(np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
    whole = Rows(*(np.concatenate(p) for p in zip(*parts)))
    return whole.of(np.lexsort((whole.y, whole.fold, whole.key)))


def held_rows(batches: Iterator[pa.RecordBatch], held_bytes: int = HELD_BYTES) -> Rows:
    """What rows_of returns, of any number of batches; beyond ``held_bytes`` the vectors are mapped from a file."""
    parts, waiting, size, file, width = [], [], 0, None, 0
    folder = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]

    def put() -> None:
        """Vectors to the file, the rest of the rows to the list."""
        nonlocal waiting, size, file, width
        part = rows_of(waiting)
        waiting, size = [], 0
        if not len(part.y):
            return
        file = file or tempfile.TemporaryFile(dir=folder)
        width = part.x.shape[1]
        file.write(np.ascontiguousarray(part.x, dtype=np.float64).data)
        parts.append((part.y, part.fold, part.key))

    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size > (LOCAL_BYTES if file else held_bytes):
            put()
    if file is None:
        return rows_of(waiting)
    put()
    y, fold, key = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((y, fold, key))
    file.flush()
    raw = np.memmap(file, dtype=np.float64, mode="r", shape=(len(y), width))
    with tempfile.TemporaryFile(dir=folder) as target:
        step = max(1, LOCAL_BYTES // (8 * width))
        for top in range(0, len(y), step):
            target.write(raw[order[top : top + step]].data)
        target.flush()
        x = np.memmap(target, dtype=np.float64, mode="r", shape=(len(y), width))
    file.close()
    return Rows(np.asarray(x), y[order], fold[order], key[order])


def in_tasks(rows: DataFrame, positive, folds: list[int], kernel: Callable[[Rows], object]) -> dict[int, object]:
    """A model per fold, one task a fold. Rows are copied once per fold."""
    listed = F.explode(F.array(*[F.lit(f) for f in folds])).alias("job")
    dealt = coded_rows(rows, positive).select("*", listed).filter("fold <> job")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.dumps(kernel(held_rows(batches)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([model], pa.binary())], ["fold", "model"])

    found = dealt.groupBy("job").applyInArrow(run, "fold int, model binary").collect()
    return {row.fold: pickle.loads(bytes(row.model)) for row in found}


def scored(rows: DataFrame, models: dict[int, object], score: Callable[[object, np.ndarray], np.ndarray]) -> DataFrame:
    """(row_id, label, fold, score) of the rows whose fold has a model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            fold, out = batch.column("fold").to_numpy(), np.zeros(batch.num_rows)
            for f in np.unique(fold):
                out[fold == f] = score(shared.value[int(f)], x[fold == f])
            columns = [batch.column(c) for c in ("row_id", "label", "fold")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], ["row_id", "label", "fold", "score"])

    kinds = rows.schema
    schema = f"row_id {kinds['row_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, fold int, score double"
    own = rows.filter(F.col("fold").isin(list(models)))
    return own.select("row_id", "label", F.col("fold").cast("int").alias("fold"), "x").mapInArrow(run, schema)


def array_sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """Element-wise sums of parts(fold, values) per fold: long in Spark, one vector per fold on the driver."""
    long = parts.select("fold", F.posexplode("values").alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("v"))
    found = long.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("k", "v")))["v"].alias("v")).collect()
    return {row.fold: np.array(row.v) for row in found}


def fold_factors(rows: DataFrame, positive, folds: list[int]) -> tuple[dict[int, tuple[float, float]], dict[int, int]]:
    """Balanced weights of both classes in every fold's training part, and its number of rows."""
    counts = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == positive).cast("long")).alias("p")).collect()
    factors, sizes = {}, {}
    for f in folds:
        n, p = sum(r.n for r in counts if r.fold != f), sum(r.p for r in counts if r.fold != f)
        factors[f] = (n / (2 * (n - p)), n / (2 * p)) if 0 < p < n else (1.0, 1.0)
        sizes[f] = n
    return factors, sizes


# --- Newton steps on sums over all rows ----------------------------------------------------------


def logistic_loss(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Loss of every row and its first and second derivative by the margin."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.logaddexp(0, margin) - y * margin, p - y, p * (1 - p)


def hinge_loss(width: float) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """The hinge max(0, 1 - margin), its corner replaced by a parabola over 1 - width to 1 + width."""

    def loss(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, ...]:
        sign = np.where(y == 1, 1.0, -1.0)
        short = 1 - sign * margin
        near = np.clip((short + width) / (2 * width), 0, 1)
        value = np.where(short >= width, short, width * near * near)
        return value, -sign * near, ((near > 0) & (near < 1)) / (2 * width)

    return loss


def newton(ready: DataFrame, factors: dict[int, tuple[float, float]], start: dict[int, np.ndarray], free_constant: bool, strength: float,
           loss: Callable, lift: Callable[[np.ndarray], np.ndarray] = lambda x: x, steps: int = 100, tolerance: float = 1e-8) -> dict[int, np.ndarray]:
    """Weights per fold (the last one is the constant) that minimise |w|^2 / 2 + strength * class-weighted losses.

    ``ready`` is what coded_rows returns, ``lift`` maps its vectors to the features. A step that raises the whole is
    halved. A pass over the rows returns loss, slope and curvature of every fold that is not finished.
    """
    context = ready.sparkSession.sparkContext
    width = len(next(iter(start.values())))
    ridge = np.ones(width)
    if free_constant:
        ridge[-1] = 0.0
    at = dict(start)  # where the next derivatives are taken
    best: dict[int, tuple[float, np.ndarray]] = {}
    open_folds = list(start)
    for _ in range(steps):
        shared = context.broadcast({f: (at[f], factors[f]) for f in open_folds})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = {f: np.zeros(1 + width + width * width) for f in shared.value}
            for batch in batches:
                part = rows_of([batch])
                if not len(part.y):
                    continue
                x = np.hstack([lift(part.x), np.ones((len(part.y), 1))])
                for f, (w, (zero, one)) in shared.value.items():
                    weight = np.where(part.y == 1, one, zero) * (part.fold != f)
                    value, first, second = loss(part.y, x @ w)
                    sums[f][0] += weight @ value
                    sums[f][1 : 1 + width] += x.T @ (weight * first)
                    bent = np.flatnonzero(second)
                    sums[f][1 + width :] += ((x[bent] * (weight * second)[bent, None]).T @ x[bent]).ravel()
            values = pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), values], ["fold", "values"])

        found = array_sums(ready.mapInArrow(run, "fold int, values array<double>"))
        for f in list(open_folds):
            w, s = at[f], found.get(f, np.zeros(1 + width + width * width))
            whole = ridge @ (w * w) / 2 + strength * s[0]
            if f in best and whole > best[f][0] + 1e-12 * abs(best[f][0]):
                if np.abs(w - best[f][1]).max() <= 1e-10 * max(1.0, np.abs(w).max()):
                    open_folds.remove(f)
                at[f] = (w + best[f][1]) / 2
                continue
            best[f] = (whole, w)
            slope = ridge * w + strength * s[1 : 1 + width]
            if np.abs(slope).max() <= tolerance * max(1.0, whole):
                open_folds.remove(f)
                continue
            curve = np.diag(ridge) + strength * s[1 + width :].reshape(width, width)
            curve[-1, -1] += 1e-9
            at[f] = w - np.linalg.solve(curve, slope)
        if not open_folds:
            break
    return {f: best[f][1] for f in start}


def logistic(rows: DataFrame, positive, folds: list[int], strength: float = 1.0, steps: int = 100) -> dict[int, np.ndarray]:
    """Logistic regression with balanced classes; the constant is penalised like the other weights."""
    factors, _ = fold_factors(rows, positive, folds)
    width = rows.select(F.size("x").alias("d")).first().d + 1
    return newton(coded_rows(rows, positive), factors, {f: np.zeros(width) for f in folds}, False, strength, logistic_loss, steps=steps)


def logistic_score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))


# --- RBF machine -------------------------------------------------------------------------------


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(square, 0))


def move_pairs(kernel: np.ndarray, sign: np.ndarray, bound: np.ndarray, alpha: np.ndarray, slope: np.ndarray, tolerance: float, most: int) -> None:
    """The most violating pair moves until none violates; ``alpha`` and ``slope`` change in place.

    The first of a pair is the steepest row, the second the one that promises the largest gain with it.
    """
    diagonal = np.diag(kernel)
    for _ in range(most):
        up = ((sign > 0) & (alpha < bound)) | ((sign < 0) & (alpha > 0))
        down = ((sign > 0) & (alpha > 0)) | ((sign < 0) & (alpha < bound))
        if not up.any() or not down.any():
            break
        rise = -sign * slope
        i = int(np.argmax(np.where(up, rise, -np.inf)))
        gap = rise[i] - rise
        if gap[down].max() < tolerance:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * kernel[i], 1e-12)
        j = int(np.argmax(np.where(down & (gap > 0), gap * gap / curve, -np.inf)))
        step = gap[j] / curve[j]
        room_i = bound[i] - alpha[i] if sign[i] > 0 else alpha[i]
        room_j = alpha[j] if sign[j] > 0 else bound[j] - alpha[j]
        step = min(step, room_i, room_j)
        for k, change in ((i, sign[i] * step), (j, -sign[j] * step)):
            alpha[k] = min(max(alpha[k] + change, 0.0), bound[k])
        slope += sign * step * (kernel[i] - kernel[j])


def constant_of(sign: np.ndarray, bound: np.ndarray, alpha: np.ndarray, slope: np.ndarray) -> float:
    rise = -sign * slope
    free = (alpha > 1e-12) & (alpha < bound * (1 - 1e-12))
    if free.any():
        return float(rise[free].mean())
    up = ((sign > 0) & (alpha < bound)) | ((sign < 0) & (alpha > 0))
    high = rise[up].max() if up.any() else 0.0
    low = rise[~up].min() if (~up).any() else high
    return float((high + low) / 2)


def dual_pairs(kernel: np.ndarray, sign: np.ndarray, bound: np.ndarray, tolerance: float = 1e-4, most: int = 10_000_000) -> tuple[np.ndarray, float]:
    """Multipliers and constant of the soft-margin machine, from the whole kernel."""
    alpha, slope = np.zeros(len(sign)), -np.ones(len(sign))
    move_pairs(kernel, sign, bound, alpha, slope, tolerance, most)
    return alpha, constant_of(sign, bound, alpha, slope)


def dual_blocks(x: np.ndarray, gamma: float, sign: np.ndarray, bound: np.ndarray, tolerance: float = 1e-4, working: int = WORKING_ROWS) -> tuple[np.ndarray, float]:
    """The same without the whole kernel: pairs move among ``working`` rows at a time, then the slopes of all rows follow.

    These rows are the most violating ones on either side and, for the rest, those that moved last.
    """
    n = len(sign)
    alpha, slope, chosen = np.zeros(n), -np.ones(n), np.zeros(0, dtype=np.int64)
    half = (x * x).sum(axis=1)
    while True:
        rise = -sign * slope
        up = np.where(((sign > 0) & (alpha < bound)) | ((sign < 0) & (alpha > 0)), rise, -np.inf)
        down = np.where(((sign > 0) & (alpha > 0)) | ((sign < 0) & (alpha < bound)), rise, np.inf)
        gap = up.max() - down.min()
        if not gap >= tolerance:
            return alpha, constant_of(sign, bound, alpha, slope)
        fresh = min(working // 4, n)
        worst = np.unique(np.concatenate([np.argpartition(-up, fresh - 1)[:fresh], np.argpartition(down, fresh - 1)[:fresh]]))
        chosen = np.concatenate([worst, chosen[~np.isin(chosen, worst)]])[:working]
        moved, own = alpha[chosen], slope[chosen]
        move_pairs(rbf(x[chosen], x[chosen], gamma), sign[chosen], bound[chosen], moved, own, max(tolerance, gap / 10), 50 * working)
        at = chosen[moved != alpha[chosen]]
        change = (sign * (-alpha))[at]
        alpha[chosen] = moved
        change += (sign * alpha)[at]
        right = np.vstack([2 * gamma * x[at].T, np.full((1, len(at)), -gamma), -gamma * half[at][None, :]])
        for top in range(0, n, KERNEL_STRIP):
            part = slice(top, top + KERNEL_STRIP)
            kernel = np.column_stack([x[part], half[part], np.ones(len(half[part]))]) @ right
            np.exp(np.minimum(kernel, 0, out=kernel), out=kernel)
            slope[part] += sign[part] * (kernel @ change)


def exact_machine(part: Rows, strength: float) -> dict:
    """Support vectors, their coefficients, the constant and gamma, 1 / (components * variance of all components)."""
    variance = part.x.var() if part.x.size else 0.0
    gamma = 1.0 / (part.x.shape[1] * variance) if variance > 0 else 1.0 / max(1, part.x.shape[1])
    zero, one = class_factors(part.y)
    sign = np.where(part.y == 1, 1.0, -1.0)
    if len(np.unique(sign)) < 2:
        return {"support": part.x[:0], "coefficient": np.zeros(0), "constant": float(sign[0]) if len(sign) else 0.0, "gamma": gamma}
    bound = strength * np.where(part.y == 1, one, zero)
    if len(sign) <= EXACT_ROWS:
        alpha, constant = dual_pairs(rbf(part.x, part.x, gamma), sign, bound)
    else:
        alpha, constant = dual_blocks(part.x, gamma, sign, bound)
    used = alpha > 1e-10
    return {"support": part.x[used], "coefficient": (alpha * sign)[used], "constant": constant, "gamma": gamma}


def machine(rows: DataFrame, positive, folds: list[int], strength: float = 10.0, exact_rows: int | None = None, landmarks: int = LANDMARKS) -> dict[int, dict]:
    """An exact kernel machine per fold; with ``exact_rows``, one on landmarks for larger training sets."""
    if exact_rows is None or max(fold_factors(rows, positive, folds)[1].values(), default=0) <= exact_rows:
        return in_tasks(rows, positive, folds, lambda part: exact_machine(part, strength))
    return {f: landmark_machine(rows.filter(F.col("fold") != f), positive, strength, landmarks) for f in folds}


def machine_score(model: dict, x: np.ndarray) -> np.ndarray:
    """Decision values."""
    if not len(model["coefficient"]):
        return np.full(len(x), model["constant"])
    step = max(1, KERNEL_VALUES // len(model["coefficient"]))
    parts = [rbf(x[top : top + step], model["support"], model["gamma"]) @ model["coefficient"] for top in range(0, len(x), step)]
    return np.concatenate([np.zeros(0), *parts]) + model["constant"]


def landmark_machine(train: DataFrame, positive, strength: float, landmarks: int, widths: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03, 0.01)) -> dict:
    """A machine on Nystroem features of hash-chosen landmarks, by Newton steps on ever sharper hinges.

    ``residual`` is the mean share of a row's kernel that the landmarks leave unexplained.
    """
    spread = train.select(F.explode("x").alias("v")).agg(F.var_pop("v").alias("v")).first()
    ready = coded_rows(train.withColumn("fold", F.lit(0)), positive)
    chosen = ready.orderBy("key", "y").limit(landmarks).select("x").distinct()
    marks = np.array([row.x for row in chosen.collect()])  # bounded by the parameter
    marks = marks[np.lexsort(marks.T)]
    gamma = 1.0 / (marks.shape[1] * spread.v) if spread.v else 1.0 / marks.shape[1]
    values, vectors = np.linalg.eigh(rbf(marks, marks, gamma))
    alive = values > 1e-10 * values.max()
    root = vectors[:, alive] / np.sqrt(values[alive])

    def lift(x: np.ndarray) -> np.ndarray:
        return rbf(x, marks, gamma) @ root

    def unexplained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = rows_of([batch])
            if len(part.y):
                phi = lift(part.x)
                yield pa.RecordBatch.from_arrays([pa.array(1 - (phi * phi).sum(axis=1))], ["left"])

    factors, _ = fold_factors(train.withColumn("fold", F.lit(0)), positive, [1])
    w = {1: np.zeros(root.shape[1] + 1)}  # fold 1 holds no row, so all rows train
    for width in widths:
        w = newton(ready, factors, w, True, strength, hinge_loss(width), lift, steps=40, tolerance=1e-6)
    residual = ready.mapInArrow(unexplained, "left double").agg(F.avg("left")).first()[0]
    return {"support": marks, "coefficient": root @ w[1][:-1], "constant": float(w[1][-1]), "gamma": gamma, "residual": residual}


# --- perceptron --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Network:
    hidden: tuple[int, ...] = (100, 50)
    penalty: float = 0.005
    rate: float = 0.001
    epochs: int = 800
    patience: int = 15
    tolerance: float = 1e-4
    held_out: float = 0.1
    batch: int = 200
    most_steps: int | None = None  # batches of an epoch, if not as many as the rows fill
    seed: int = 42

    def steps(self, rows: int) -> int:
        """Batches of an epoch on so many training rows."""
        filled = max(1, math.ceil((1 - self.held_out) * rows / self.batch))
        return filled if self.most_steps is None else min(filled, self.most_steps)

    def start(self, width: int) -> list[np.ndarray]:
        """Uniform weights whose bound follows the layer's sizes; weights and constants alternate."""
        rng, sizes, out = np.random.default_rng(self.seed), (width, *self.hidden, 1), []
        for a, b in zip(sizes, sizes[1:]):
            bound = math.sqrt((2.0 if b == 1 else 6.0) / (a + b))
            out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        return out


def forward(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer; the last one holds margins."""
    out = [x]
    for k in range(0, len(weights), 2):
        z = out[-1] @ weights[k] + weights[k + 1]
        out.append(np.maximum(z, 0) if k + 2 < len(weights) else z)
    return out


def gradient_sums(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Summed gradients and losses of a batch, without penalty and not yet divided by its size."""
    layers = forward(weights, x)
    margin = layers[-1][:, 0]
    loss = float((np.logaddexp(0, margin) - y * margin).sum())
    back = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y)[:, None]
    out = []
    for k in range(len(weights) - 2, -1, -2):
        out = [layers[k // 2].T @ back, back.sum(axis=0), *out]
        if k:
            back = (back @ weights[k].T) * (layers[k // 2] > 0)
    return out, loss


class Adam:
    def __init__(self, weights: list[np.ndarray], net: Network):
        self.net, self.weights, self.count = net, weights, 0
        self.first, self.second = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def step(self, sums: list[np.ndarray], n: int) -> None:
        self.count += 1
        rate = self.net.rate * math.sqrt(1 - 0.999**self.count) / (1 - 0.9**self.count)
        for k, (w, s) in enumerate(zip(self.weights, sums)):
            g = (s + self.net.penalty * w if k % 2 == 0 else s) / n
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            self.weights[k] = w - rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)


class Stopping:
    """Keeps the weights of the best held-out accuracy; over after `patience` epochs without a gain above tolerance."""

    def __init__(self, net: Network):
        self.net, self.best, self.kept, self.idle = net, -np.inf, None, 0

    def over(self, accuracy: float, weights: list[np.ndarray]) -> bool:
        self.idle = 0 if accuracy > self.best + self.net.tolerance else self.idle + 1
        if accuracy > self.best:
            self.best, self.kept = accuracy, [w.copy() for w in weights]
        return self.idle >= self.net.patience


def batch_of(net: Network, key: np.ndarray, epoch: int, steps: int) -> np.ndarray:
    """The batch of every row in an epoch; held-out rows have -1."""
    dealt = (hashed(net.seed, epoch, key) % np.uint64(steps)).astype(int)
    return np.where(uniform(net.seed + 1, key) < net.held_out, -1, dealt)


def network_of(part: Rows, net: Network, steps: int | None = None) -> dict:
    """Weights and the loss of every epoch, trained on rows in one task."""
    steps = steps or net.steps(len(part.y))
    adam, stop, losses = Adam(net.start(part.x.shape[1]), net), Stopping(net), []
    for epoch in range(net.epochs):
        batch, total, n = batch_of(net, part.key, epoch, steps), 0.0, 0
        order = np.argsort(batch, kind="stable")
        ends = np.searchsorted(batch[order], np.arange(-1, steps), side="right")
        for k in range(steps):
            own = order[ends[k] : ends[k + 1]]
            if len(own):
                sums, loss = gradient_sums(adam.weights, part.x[own], part.y[own])
                total, n = total + loss, n + len(own)
                adam.step(sums, len(own))
        losses.append(total / max(1, n))
        own, right = order[: ends[0]], 0
        for some in np.split(own, range(HELD_OUT, len(own), HELD_OUT)):
            right += int(((forward(adam.weights, part.x[some])[-1][:, 0] > 0) == (part.y[some] == 1)).sum())
        if stop.over(right / max(1, len(own)), adam.weights):
            break
    return {"weights": stop.kept, "losses": losses}


def networks_over_tasks(rows: DataFrame, positive, folds: list[int], net: Network, steps: int) -> dict[int, dict]:
    """The same training with every batch's gradients summed over all tasks; folds share the passes."""
    ready = stage(coded_rows(rows, positive))
    context = rows.sparkSession.sparkContext
    width = rows.select(F.size("x").alias("d")).first().d
    adams, stops = {f: Adam(net.start(width), net) for f in folds}, {f: Stopping(net) for f in folds}
    losses: dict[int, list[float]] = {f: [] for f in folds}
    live = list(folds)

    def sums_of(epoch: int, k: int) -> dict[int, np.ndarray]:
        """[rows, loss or hits, gradients...] of one batch, or of the held-out rows (-1)."""
        shared = context.broadcast({f: adams[f].weights for f in live})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                part = rows_of([b])
                if not len(part.y):
                    continue
                part = part.of(batch_of(net, part.key, epoch, steps) == k)
                for f, weights in shared.value.items():
                    own = part.of(part.fold != f)
                    if not len(own.y):
                        continue
                    if k < 0:
                        hits = ((forward(weights, own.x)[-1][:, 0] > 0) == (own.y == 1)).sum()
                        found = np.array([len(own.y), hits], dtype=float)
                    else:
                        sums, loss = gradient_sums(weights, own.x, own.y)
                        found = np.concatenate([[len(own.y), loss], *[s.ravel() for s in sums]])
                    out[f] = out.get(f, 0) + found
            values = pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), values], ["fold", "values"])

        return array_sums(ready.mapInArrow(run, "fold int, values array<double>"))

    for epoch in range(net.epochs):
        seen = {f: np.zeros(2) for f in live}
        for k in range(steps):
            for f, flat in sums_of(epoch, k).items():
                seen[f] += flat[:2]
                cuts = np.cumsum([w.size for w in adams[f].weights])[:-1]
                parts = np.split(flat[2:], cuts)
                adams[f].step([p.reshape(w.shape) for p, w in zip(parts, adams[f].weights)], int(flat[0]))
        right = sums_of(epoch, -1)
        for f in list(live):
            losses[f].append(float(seen[f][1] / max(1, seen[f][0])))
            n, hits = right[f][:2] if f in right else (1, 0)
            if stops[f].over(float(hits / n), adams[f].weights):
                live.remove(f)
        if not live:
            break
    return {f: {"weights": stops[f].kept, "losses": losses[f]} for f in folds}


def perceptron(rows: DataFrame, positive, folds: list[int], net: Network = Network(), local_bytes: int | None = None) -> dict[int, dict]:
    """A network per fold, trained in the fold's task; with ``local_bytes``, larger sets take the same steps over all tasks."""
    if local_bytes is not None:
        _, sizes = fold_factors(rows, positive, folds)
        width, n = rows.select(F.size("x").alias("d")).first().d, max(sizes.values(), default=0)
        if n * width * 8 > local_bytes:
            return networks_over_tasks(rows, positive, folds, net, net.steps(n))
    return in_tasks(rows, positive, folds, lambda part: network_of(part, net))


def network_score(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(forward(model["weights"], x)[-1][:, 0], -500, 500)))
