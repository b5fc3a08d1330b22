"""Training of the student network: gradients of a batch as sums over tasks, steps on the driver.

Rows are (id, x, y): a history and the teacher's vector. An epoch's rows are laid out once, batch after batch, and a step is a job over the partitions that hold
its batch only, so its work does not grow with the data: each of these tasks adds up the gradients of its rows of the batch, and sums of a fixed size, the
network's own, reach the driver, which clips and takes a step of Adam. A batch has SALTS parts at most, each read as a stream. Results are those of
one machine up to the rounding of sums, however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.kinematics import finite
from .batches import mini_batches

Layers = list[tuple[np.ndarray, np.ndarray]]
SUMS = "salt int, n long, mse double, cos double, gradient binary"
#: Groups in which the sums of tasks are added up before the last sum, and the most parts of a batch.
SALTS = 64
#: Rows of a part of a batch, until it has SALTS parts, and of a partition of several small batches.
PART = 4096
TINY = 1e-8


def first_layers(sizes: tuple[int, ...], seed: int = 0) -> Layers:
    """Weights and biases uniform within 1 / sqrt(inputs)."""
    r = np.random.default_rng(seed)
    return [(r.uniform(-1, 1, (a, b)) / a**0.5, r.uniform(-1, 1, b) / a**0.5) for a, b in zip(sizes, sizes[1:])]


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in layers for p in layer])


def shaped(values: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """Outputs of all layers, the input first; the last has no ReLU."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
    return out


def cosines(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosine of rows, and the norms, at least TINY each."""
    a, b = (np.maximum(np.sqrt((v * v).sum(1)), TINY) for v in (p, y))
    return (p * y).sum(1) / (a * b), a, b


def sums_of(layers: Layers, x: np.ndarray, y: np.ndarray, lambda_cos: float) -> tuple[float, float, np.ndarray]:
    """Sums over rows of the mean squared error and the cosine, and of the gradient of mse + lambda_cos (1 - cos)."""
    outs = forward(layers, x)
    p = outs[-1]
    cos, a, b = cosines(p, y)
    slope = 2 * (p - y) / y.shape[1] - lambda_cos * (y / (a * b)[:, None] - p * (cos / a**2 * (a > TINY))[:, None])
    grads: Layers = []
    for k in range(len(layers) - 1, -1, -1):
        grads.append((outs[k].T @ slope, slope.sum(0)))
        if k:
            slope = (slope @ layers[k][0].T) * (outs[k] > 0)
    return float(((p - y) ** 2).mean(1).sum()), float(cos.sum()), flat(grads[::-1])


def step_sums(rows: DataFrame, layers: Layers, lambda_cos: float, with_gradient: bool = True) -> tuple[int, float, float, np.ndarray]:
    """(n, mean mse, mean cos, mean gradient) over rows (x, y), in one job."""
    size = flat(layers).size if with_gradient else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, mse, cos, gradient = 0, 0.0, 0.0, np.zeros(size)
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("x", "y"))
                m, c, g = sums_of(layers, x, y, lambda_cos)
                n, mse, cos = n + b.num_rows, mse + m, cos + c
                gradient = gradient + g if with_gradient else gradient
        if n:
            yield batch(TaskContext.get().partitionId() % SALTS, n, mse, cos, gradient)

    def batch(salt: int, n: int, mse: float, cos: float, gradient: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([v], t) for v, t in ((salt, pa.int32()), (n, pa.int64()), (mse, pa.float64()), (cos, pa.float64()), (gradient.tobytes(), pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, names=["salt", "n", "mse", "cos", "gradient"])

    def added(t: pa.Table) -> pa.Table:
        gradient = np.zeros(size)
        for g in t["gradient"]:
            gradient += np.frombuffer(g.as_py())
        total = [float(np.sum(t[c].to_numpy())) for c in ("n", "mse", "cos")]
        return pa.Table.from_batches([batch(t["salt"][0].as_py(), int(total[0]), total[1], total[2], gradient)])

    parts = rows.select("x", "y").mapInArrow(run, SUMS).groupBy("salt").applyInArrow(added, SUMS)
    found = sorted(parts.collect(), key=lambda r: r["salt"])
    n = sum(r["n"] for r in found)
    if not n:
        return 0, float("nan"), float("nan"), np.zeros(size)
    return n, sum(r["mse"] for r in found) / n, sum(r["cos"] for r in found) / n, sum((np.frombuffer(r["gradient"]) for r in found), np.zeros(size)) / n


PACKED = "batch long, n long, x binary, y binary"


def laid_out(mixed: DataFrame, rows: int, size: int) -> tuple[DataFrame, int, int]:
    """(PACKED, parts, together) of mini_batches() of `size` rows, `rows` in all: batches as matrices of rows of doubles. If batches are large, each has `parts`
    partitions and `together` is 1; if they are small, each partition holds `together` of them whole."""
    parts, together = max(1, min(SALTS, -(-min(size, rows) // PART))), max(1, PART // size)
    batches = -(-rows // size)

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            if not b.num_rows:
                continue
            at = b.column("batch").to_numpy()
            x, y = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("x", "y"))
            for k in np.unique(at).tolist():
                mine = at == k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([int(mine.sum())], pa.int64()), pa.array([x[mine].tobytes()], pa.binary()), pa.array([y[mine].tobytes()], pa.binary())], names=["batch", "n", "x", "y"]
                )

    part = F.floor(F.col("batch") / together) * parts + F.col("place") % parts
    placed = mixed.withColumn("_part", part.cast("int")).repartitionById(-(-batches // together) * parts, "_part").sortWithinPartitions("_part", "batch")
    return placed.select("batch", "x", "y").mapInArrow(pack, PACKED), parts, together


def batch_sums(packed: RDD, batch: int, parts: int, together: int, layers: Layers, lambda_cos: float) -> tuple[int, float, float, np.ndarray]:
    """(n, mean mse, mean cos, mean gradient) of one batch of laid_out(), in one job over its partitions."""

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, float, float, np.ndarray]]:
        n, mse, cos, gradient = 0, 0.0, 0.0, np.zeros(flat(layers).size)
        for r in rows:
            if r["batch"] == batch:
                x, y = (np.frombuffer(r[c]).reshape(r["n"], -1) for c in ("x", "y"))
                m, c, g = sums_of(layers, x, y, lambda_cos)
                n, mse, cos, gradient = n + r["n"], mse + m, cos + c, gradient + g
        yield n, mse, cos, gradient

    first = batch // together * parts
    found = packed.context.runJob(packed, run, range(first, first + parts))
    n = sum(f[0] for f in found)
    return n, sum(f[1] for f in found) / n, sum(f[2] for f in found) / n, sum(f[3] for f in found) / n


@dataclass
class Adam:
    """Steps of Adam, with weight decay added to gradients that have been cut to a norm."""

    rate: float
    decay: float = 0.0
    most: float = 5.0
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    turn: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))
    second: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def step(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        norm = float(np.sqrt(gradient @ gradient))
        gradient = gradient * min(1.0, self.most / (norm + 1e-6)) + self.decay * values
        if not self.turn:
            self.first, self.second = np.zeros_like(values), np.zeros_like(values)
        self.turn += 1
        a, b = self.betas
        self.first, self.second = a * self.first + (1 - a) * gradient, b * self.second + (1 - b) * gradient**2
        return values - self.rate * (self.first / (1 - a**self.turn)) / (np.sqrt(self.second / (1 - b**self.turn)) + self.eps)


HISTORY = "epoch int, train_mse double, train_cos double, train_metric double, val_mse double, val_cos double, val_metric double, best_val_metric double"


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose x and y are there and hold finite numbers only."""
    good = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(finite(v), F.lit(False)))
    return rows.where(good("x") & good("y")).select("id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))


def train_student(
    train: DataFrame, validation: DataFrame, hidden: int = 128, epochs: int = 100, batch: int = 32, rate: float = 3e-6, decay: float = 0.0, lambda_cos: float = 0.4, most: float = 5.0, seed: int = 42
) -> tuple[Layers, DataFrame]:
    """The weights of the epoch with the least validation metric, the earlier one on ties, and HISTORY.

    train, validation: (id, x, y), standardised; rows that are not usable() take no part, and none left is an error. Batches are drawn anew each epoch; a step is a job
    over its batch, steps follow each other, so on large data take large batches. The metric is mse + lambda_cos (1 - cos).
    """
    rows, tests = usable(train).persist(), usable(validation).persist()
    try:
        widths = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.min(F.size("y")), F.max(F.size("y")), F.count("*")).first()
        if not widths[4] or widths[0] != widths[1] or widths[2] != widths[3]:
            raise ValueError(f"{widths[4]} usable rows of widths {list(widths[:4])}")
        layers = first_layers((widths[0], hidden, hidden, widths[2]), seed)
        values, adam, history, best = flat(layers), Adam(rate, decay, most), [], None
        for epoch in range(1, epochs + 1):
            packed, parts, together = laid_out(mini_batches(rows, batch, "id", seed, epoch), widths[4], batch)
            packed.persist().count()
            seen, mse, cos = 0, 0.0, 0.0
            for k in range(-(-widths[4] // batch)):
                n, m, c, g = batch_sums(packed.rdd, k, parts, together, shaped(values, layers), lambda_cos)
                values = adam.step(values, g)
                seen, mse, cos = seen + n, mse + n * m, cos + n * c
            packed.unpersist()
            mse, cos = mse / seen, cos / seen
            _, val_mse, val_cos, _ = step_sums(tests, shaped(values, layers), lambda_cos, with_gradient=False)
            metric = val_mse + lambda_cos * (1 - val_cos)
            if best is None or metric < best[0]:
                best = metric, values
            history.append((epoch, mse, cos, mse + lambda_cos * (1 - cos), val_mse, val_cos, metric, best[0]))
    finally:
        rows.unpersist(), tests.unpersist()
    return shaped(best[1], layers), train.sparkSession.createDataFrame(history, HISTORY)
