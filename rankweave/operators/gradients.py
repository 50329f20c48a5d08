"""Full-batch gradient descent of many models at once, over training rows that stay dealt out.

Every step needs the sum of a gradient over all rows, and the number of steps is part of the result.
Rows are packed once into arrays, a block for each model and partition, and kept; a step is one job
that adds up each block's gradients of all models that still move, and the driver moves them. It sees
sums and parameters, never a row. A lost executor's blocks are computed again. Training sets of up to
``LOCAL`` rows in all, a bounded number, take their steps inside the tasks that hold their blocks instead,
for a job a step would cost them more than the arithmetic. The rows of one key (a query) stay together, for some
models scale a query's signals by their range.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import AttentionWeights, LearnableWeights, Transform, composite_prior, descend, fit_by_group, logit, min_max, safe, sigmoid

#: The arrays of a block's rows, from their frame; and the sum of the gradient over them at given parameters.
Prepare = Callable[[pd.DataFrame], tuple]
Sums = Callable[..., np.ndarray]
#: Rows of all models together up to which their steps need no job each.
LOCAL = 200_000

_BLOCK = "model int, n long, positive long, block binary"


def _pack(order: list[str], prepare: Prepare):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).to_pandas().sort_values(["model", *order], kind="stable")
        for m, p in rows.groupby("model", sort=True):
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([len(p)], pa.int64()), pa.array([int((p.label > 0).sum())], pa.int64()), pa.array([pickle.dumps(prepare(p))], pa.binary())], names=["model", "n", "positive", "block"])

    return run


def _descend(theta: dict, size: dict[int, int], total: Callable[[list], np.ndarray], rate: float, steps: int, tol: float) -> dict:
    """``theta``[(model, start)] moved until each has moved by less than ``tol`` or ``steps`` are done; ``total`` gives the sums of those that move."""
    moving = sorted(theta)
    for _ in range(steps):
        if not moving:
            break
        sums, at, still = total(moving), 0, []
        for m, k in moving:
            move = rate * sums[at : at + len(theta[m, k])] / size[m]
            at += len(move)
            theta[m, k] = theta[m, k] - move
            if np.abs(move).max(initial=0.0) >= tol:
                still.append((m, k))
        moving = still
    return theta


def _block_sums(theta: dict, moving: list, sums: Sums, blocks: dict[int, list[tuple]]) -> np.ndarray:
    return np.concatenate([sum((np.asarray(sums(theta[m, k], *b), float) for b in blocks.get(m, [])), np.zeros_like(theta[m, k])) for m, k in moving])


def _local(starts: list[np.ndarray], size: dict[int, int], sums: Sums, rate: float, steps: int, tol: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple]] = {}
        for b in batches:
            for m, block in zip(b.column("model").to_pylist(), b.column("block").to_pylist(), strict=True):
                if m in size:
                    blocks.setdefault(m, []).append(pickle.loads(block))
        theta = {(m, k): s.astype(float) for m in blocks for k, s in enumerate(starts)}
        theta = _descend(theta, size, lambda moving: _block_sums(theta, moving, sums, blocks), rate, steps, tol)
        keys = sorted(theta)
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([theta[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["model", "start", "theta"])

    return run


def fit_together(rows: DataFrame, key: str, order: list[str], starts: Sequence[np.ndarray], prepare: Prepare, sums: Sums, *, rate: float = 0.01, steps: int = 1000, tol: float = 1e-6, least: int = 1, both: bool = False) -> dict[int, tuple[int, list[np.ndarray]]]:
    """{model: (rows, parameters from each start)}, by ``steps`` moves at most of ``rate`` times the mean gradient.

    rows(model, key, label, ...): rows of one ``key`` stay in one block and stand in ``order`` there. A model with
    fewer than ``least`` rows, or (with ``both``) without both classes, has no entry. A move of less than
    ``tol`` everywhere is the last of its parameters.
    """
    starts = list(starts)
    packed = rows.withColumn("model", F.col("model").cast("int")).repartition("model", key).mapInArrow(_pack(list(order), prepare), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = packed.groupBy("model").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).collect()  # a row for each model
        size = {r.model: r.n for r in counts if r.n >= max(least, 1) and (not both or 0 < r.positive < r.n)}
        if sum(size.values()) <= LOCAL:
            got = packed.repartition(max(1, len(size)), "model").mapInArrow(_local(starts, size, sums, rate, steps, tol), "model int, start int, theta array<double>").collect() if size else []
            theta = {(r.model, r.start): np.array(r.theta) for r in got}
        else:
            theta = _by_jobs(packed, {(m, k): s.astype(float) for m in size for k, s in enumerate(starts)}, size, sums, rate, steps, tol)
    finally:
        packed.unpersist()
    return {m: (n, [theta[m, k] for k in range(len(starts))]) for m, n in sorted(size.items())}


def _by_jobs(packed: DataFrame, theta: dict, size: dict[int, int], sums: Sums, rate: float, steps: int, tol: float) -> dict:
    blocks = packed.select("model", "block").rdd.map(lambda r: (r.model, bytes(r.block))).persist(StorageLevel.MEMORY_AND_DISK)  # bytes in Python's form: a step is arithmetic alone

    def total(moving: list) -> np.ndarray:
        now = {k: theta[k] for k in moving}

        def part(rows: Iterator[tuple[int, bytes]]) -> Iterator[np.ndarray]:
            out = np.zeros(sum(len(now[k]) for k in moving))
            for m, block in rows:
                if any(m == k for k, _ in moving):
                    out += _block_sums(now, moving, sums, {m: [pickle.loads(block)]})
            yield out

        return blocks.mapPartitions(part).treeReduce(np.add)

    try:
        return _descend(theta, size, total, rate, steps, tol)
    finally:
        blocks.unpersist()


def fit_attention(rows: DataFrame, signals: list[str], features: list[str], heads: list[AttentionWeights], *, rate: float = 0.01, steps: int = 500, tol: float = 1e-6, least: int = 10) -> dict[int, list[np.ndarray]]:
    """{model: each head's parameters} of rows(model, query_id, doc_id, label, signals, features)."""
    one = heads[0]

    def prepare(p: pd.DataFrame) -> tuple:
        x = logit(p[signals].to_numpy())
        if one.normalize:
            for at in p.groupby("query_id", sort=False).indices.values():
                x[at] = min_max(x[at])
        return x, p.label.to_numpy(), p[features].to_numpy()

    got = fit_together(rows, "query_id", ["query_id", "doc_id"], [h.state.theta for h in heads], prepare, one.gradient_sum, rate=rate, steps=steps, tol=tol, least=least, both=True)
    return {m: theta for m, (_, theta) in got.items()}


def fit_learnable(rows: DataFrame, signals: list[str], *, alpha: float = 0.0, base_rate: float | None = None, rate: float = 0.1, steps: int = 300, tol: float = 1e-9) -> dict[int, np.ndarray]:
    """{model: softmax weights} of rows(model, query_id, doc_id, label, signals)."""
    w = LearnableWeights(len(signals), alpha, base_rate)
    got = fit_together(rows, "query_id", ["query_id", "doc_id"], [w.state.theta], lambda p: (logit(p[signals].to_numpy()), p.label.to_numpy()), w.gradient_sum, rate=rate, steps=steps, tol=tol)
    out = {}
    for m, (_, (theta,)) in got.items():
        w.state.theta = theta
        out[m] = w.weights
    return out


def fit_sigmoid(rows: DataFrame, *, start: tuple[float, float] = (1.0, 0.0), aware: bool = False, half_life: float | None = None, rate: float = 0.01, steps: int = 1000, tol: float = 1e-6, key: str = "query_id", order: tuple[str, ...] = ("query_id", "doc_id")) -> dict[int, tuple[int, float, float]]:
    """{model: (rows, alpha, beta)} of rows(model, key, label, score[, tf, ratio][, time]).

    ``aware`` takes the composite prior of tf and ratio into the gradient; with a ``half_life`` a row weighs
    half as much for each that it is older than the newest of its model, all weights together as much as the rows.
    """
    rows = rows.withColumn("model", F.col("model").cast("int"))
    if half_life:
        age = F.greatest(F.lit(0.0), F.col("newest")) - F.col("time")
        aged = rows.join(F.broadcast(rows.groupBy("model").agg(F.max("time").cast("double").alias("newest"))), "model").withColumn("w", F.exp(-math.log(2) / half_life * age))
        share = aged.groupBy("model").agg((F.count("*") / F.sum("w")).alias("share"))  # a row for each model
        rows = aged.join(F.broadcast(share), "model").withColumn("weight", F.col("w") * F.col("share"))

    def prepare(p: pd.DataFrame) -> tuple:
        prior = composite_prior(p.tf.to_numpy(), p.ratio.to_numpy()) if aware else None
        return p.score.to_numpy(float), p.label.to_numpy(float), prior, p.weight.to_numpy() if half_life else None

    got = fit_together(rows, key, list(order), [np.array(start, float)], prepare, lambda t, *data: Transform.gradient(t, *data, n=1), rate=rate, steps=steps, tol=tol)
    return {m: (n, float(t[0]), float(t[1])) for m, (n, (t,)) in got.items()}


#: Bins of a score's unit in :func:`fit_sigmoid_binned`.
SIGMOID_BINS = 1 << 8


def fit_sigmoid_binned(rows: DataFrame, *, start: tuple[float, float] = (1.0, 0.0), rate: float = 0.01, steps: int = 1000, tol: float = 1e-6) -> tuple[int, float, float]:
    """(rows, alpha, beta) of rows(score, label), as :func:`fit_sigmoid` without priors or ages gives them, in one job.

    Rows of a label are summed up by bins of the score ``1 / SIGMOID_BINS`` wide: their number and the sums of the first five
    powers of the distance to the bin's middle. Inside a bin the sigmoid is its series to the fourth power, whose rest is
    below 1e-16 * alpha ** 5; so all rows count, and the fit is that of the rows to rounding. A bin is a row, so
    the range of the score bounds what the task that descends holds.
    """
    d = F.col("score") - (F.col("bin") + 0.5) / SIGMOID_BINS
    binned = rows.select(F.floor(F.col("score") * SIGMOID_BINS).alias("bin"), "label", "score")
    powers = [F.sum(F.lit(1.0)), F.sum(d), F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d), F.sum(d * d * d * d * d)]
    sums = binned.groupBy("bin", "label").agg(*(p.alias(f"m{i}") for i, p in enumerate(powers))).withColumn("model", F.lit(0))

    def fit(p: pd.DataFrame) -> dict:
        m, y, mid = p[[f"m{i}" for i in range(6)]].to_numpy().T, p.label.to_numpy(float), (p.bin.to_numpy() + 0.5) / SIGMOID_BINS
        n = m[0].sum()

        def gradient(t: np.ndarray) -> np.ndarray:
            a, b = t
            like = safe(sigmoid(a * (mid - b)))
            v = like * (1 - like)
            series = [like - y, a * v, a**2 * v * (1 - 2 * like) / 2, a**3 * v * (1 - 6 * v) / 6, a**4 * v * (1 - 2 * like) * (1 - 12 * v) / 24]
            error, slope = sum(c * m[i] for i, c in enumerate(series)), sum(c * m[i + 1] for i, c in enumerate(series))
            return np.array([(error * (mid - b) + slope).sum(), -a * error.sum()]) / n

        alpha, beta = descend(np.array(start, float), gradient, rate, steps, tol)
        return {"n": int(n), "alpha": float(alpha), "beta": float(beta)}

    got = fit_by_group(sums, ["model"], fit, "n long, alpha double, beta double", ["bin", "label"]).collect()
    return (got[0].n, got[0].alpha, got[0].beta) if got else (0, *start)
