"""Base rates and automatic parameters from the scores of pseudo-queries; shuffles and splits."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index
from .scoring import sparse_scores


def shuffled(n: int, seed: int) -> list[int]:
    """Fisher-Yates over 0..n-1 with a 32-bit congruential generator."""
    out, state = list(range(n)), seed & 0xFFFFFFFF
    for i in range(n - 1, 0, -1):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        j = state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


_FACTOR, _TERM, _CHUNK = 1664525, 1013904223, 1 << 16


def jumped(state: int, steps: int) -> int:
    """The generator's state after ``steps`` steps, by squaring one step's factor and term."""
    factor, term, a, b = 1, 0, _FACTOR, _TERM
    while steps:
        if steps & 1:
            factor, term = factor * a & 0xFFFFFFFF, (term * a + b) & 0xFFFFFFFF
        a, b = a * a & 0xFFFFFFFF, (a * b + b) & 0xFFFFFFFF
        steps >>= 1
    return (factor * state + term) & 0xFFFFFFFF


def first_shuffled(n: int, k: int, seed: int) -> np.ndarray:
    """``shuffled(n, seed)[:k]``, by undoing the swaps for the first ``k`` places only.

    The swaps come in the opposite order of the generator, so it is jumped to the end of each chunk of
    them; memory is one chunk and the ``k`` places, whatever ``n``. A swap moves one of the places that are
    followed only where its partner is one, which happens about k * log(n / k) times.
    """
    k = min(n, k)
    if n < 2 or not k:
        return np.arange(k)
    powers = np.cumprod(np.full(_CHUNK, _FACTOR, np.uint32), dtype=np.uint32)
    sums = np.cumsum(np.concatenate([[1], powers[:-1]]).astype(np.uint32), dtype=np.uint32) * np.uint32(_TERM)
    slot = {p: p for p in range(k)}  # where a place of the result stands now
    for lo in range(1, n, _CHUNK):
        size = min(_CHUNK, n - lo)
        before = np.uint32(jumped(seed & 0xFFFFFFFF, n - lo - size))  # the swap of i takes the state after n - i steps
        other = (powers[:size] * before + sums[:size])[::-1].astype(np.int64) % np.arange(lo + 1, lo + size + 1)
        due = np.flatnonzero(np.isin(other, np.fromiter(slot, np.int64, len(slot)))).tolist()
        due += [i - lo for i in slot if lo <= i < lo + size]
        heapq.heapify(due)
        last = -1
        while due:
            at = heapq.heappop(due)
            i, j = lo + at, int(other[at])
            if at == last or i == j:
                continue
            last = at
            x, y = slot.pop(i, None), slot.pop(j, None)
            for value, to in ((x, j), (y, i)):
                if value is not None:
                    slot[to] = value
                    for later in (at + 1 + np.flatnonzero(other[at + 1 :] == to)).tolist():
                        heapq.heappush(due, later)
    out = np.empty(k, np.int64)
    out[list(slot.values())] = list(slot)
    return out


def split_queries(ids: list, ratio: float, seed: int) -> tuple[list, list]:
    if len(ids) < 2:
        return list(ids), []
    order = [ids[i] for i in shuffled(len(ids), seed)]
    n = min(len(ids) - 1, max(1, math.floor(len(ids) * ratio + 0.5)))
    return order[:n], order[n:]


def folds(ids: list, k: int, seed: int) -> list[list]:
    order = [ids[i] for i in shuffled(len(ids), seed)]
    k = min(max(2, k), len(order))
    return [order[i::k] for i in range(k)]


def pseudo_scores(index: Index, ids: list, length: int = 5) -> DataFrame:
    """(query_id, doc_id, score > 0) with the first ``length`` tokens of the documents ``ids`` as queries."""
    terms = index.docs.where(F.col("doc_id").isin(ids)).select(F.col("doc_id").alias("query_id"), F.explode(F.slice("tokens", 1, length)).alias("term"))
    queries = terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return sparse_scores(index, queries).where("bm25 > 0").select("query_id", "doc_id", F.col("bm25").alias("score"))


def auto_parameters(scores: DataFrame) -> DataFrame:
    """One row: alpha (one over the deviation) and beta (the median); 1 and 0 without scores."""
    sd = F.stddev_pop("score")
    return scores.agg(F.when(sd > 0, 1.0 / F.when(sd > 0, sd)).otherwise(1.0).alias("alpha"), F.coalesce(F.percentile("score", F.lit(0.5)), F.lit(0.0)).alias("beta"))


def clip_rate(c):
    return F.least(F.greatest(c, F.lit(1e-6)), F.lit(0.5))


def percentile_rate(scores: DataFrame, n_docs: int, q: float = 0.95) -> DataFrame:
    """The mean share of documents at or above each pseudo-query's ``q`` quantile, at nine digits: equal scores are interpolated inexactly."""
    cut = scores.groupBy("query_id").agg(F.percentile("score", F.lit(q)).alias("cut"))
    share = scores.join(cut, "query_id").groupBy("query_id").agg((F.sum((F.round("score", 9) >= F.round("cut", 9)).cast("int")) / float(max(n_docs, 1))).alias("share"))
    return share.agg(clip_rate(F.coalesce(F.avg("share"), F.lit(0.0))).alias("base_rate"))


def elbow_rate(scores: DataFrame) -> DataFrame:
    """The place furthest from the chord of the falling score curve, as a share of it.

    Among equal scores the distance is largest at their first or last place, so the curve is
    taken by distinct score with its places, counted by sums over the ranges of a range
    partitioning; no row is numbered in one task.
    """
    by = scores.groupBy("score").agg(F.count("*").alias("c")).repartitionByRange(F.col("score").desc()).select("*", F.spark_partition_id().alias("part")).persist()
    ends = by.agg(F.max("score").alias("high"), F.min("score").alias("low"), F.sum("c").alias("n"))  # one row
    parts = by.groupBy("part").agg(F.sum("c").alias("c"))  # a row for each partition
    before = parts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("c").over(Window.partitionBy("part").orderBy(F.col("score").desc()))
    rows = by.withColumn("within", within).join(F.broadcast(before), "part").crossJoin(F.broadcast(ends))
    last = F.col("before") + F.col("within") - 1
    at = F.explode(F.array(last - F.col("c") + 1, last)).alias("at")
    far = F.abs((F.col("low") - F.col("high")) * F.col("at") - (F.col("n") - 1) * (F.col("score") - F.col("high")))
    best = rows.select("score", "high", "low", "n", at).groupBy("n", "high", "low").agg(F.max_by("at", F.struct(F.round(far, 9), -F.col("at"))).alias("at"))
    flat = (F.col("n") < 3) | (F.sqrt((F.col("n") - 1) * (F.col("n") - 1) + (F.col("low") - F.col("high")) * (F.col("low") - F.col("high"))) < 1e-12)
    rate = F.when(flat, 1e-6).otherwise(F.least(F.greatest(F.greatest("at", F.lit(1)) / F.col("n"), F.lit(1e-6)), F.lit(0.5)))
    return best.agg(F.coalesce(F.max(rate), F.lit(1e-6)).alias("base_rate"))


def mixture_rate(scores: DataFrame, steps: int = 20) -> DataFrame:
    """The share of the upper of two normal components, by expectation and maximisation as sums over all scores."""
    x = scores.select(F.col("score").cast("double").alias("x")).persist()
    first = x.agg(F.count("*").alias("n"), F.percentile("x", F.lit(0.5)).alias("mid")).first()
    out = lambda share: scores.sparkSession.createDataFrame([(float(min(0.5, max(1e-6, share))),)], "base_rate double")
    if first.n < 2:
        return out(0.0)
    side = [F.when(F.col("x") <= first.mid, F.col("x")), F.when(F.col("x") > first.mid, F.col("x"))]
    start = x.agg(*(f(c) for c in side for f in (F.avg, F.var_pop))).first()
    mu = [first.mid + d if m is None else m for m, d in zip(start[::2], (-1.0, 1.0), strict=True)]
    var = [max(1.0 if v is None else v, 1e-8) for v in start[1::2]]
    share = 0.5
    for _ in range(steps):
        log = [-0.5 * (F.col("x") - m) * (F.col("x") - m) / v - 0.5 * math.log(v) + math.log(max(p, 1e-10)) for m, v, p in zip(mu, var, (1 - share, share), strict=True)]
        g1 = 1 / (1 + F.exp(F.least(F.greatest(log[0] - log[1], F.lit(-700.0)), F.lit(700.0))))
        rows = x.select("x", g1.alias("g1")).withColumn("g0", 1 - F.col("g1"))
        mass = rows.agg(*(f for g in ("g0", "g1") for f in (F.sum(g), F.sum(F.col(g) * F.col("x"))))).first()
        if min(mass[0], mass[2]) < 1e-8:
            break
        mu = [mass[1] / mass[0], mass[3] / mass[2]]
        spread = rows.agg(*(F.sum(F.col(g) * (F.col("x") - m) * (F.col("x") - m)) for g, m in zip(("g0", "g1"), mu, strict=True))).first()
        var = [max(s / m, 1e-8) for s, m in zip(spread, (mass[0], mass[2]), strict=True)]
        share = mass[2] / first.n
    x.unpersist()
    return out(share if mu[1] >= mu[0] else 1 - share)


def elbow(falling) -> float:
    s = np.asarray(falling, float)
    n = len(s)
    if n < 3:
        return 1e-6
    dx, dy = n - 1, s[-1] - s[0]
    length = math.hypot(dx, dy)
    if length < 1e-12:
        return 1e-6
    far = int(np.argmax(np.abs(dy * np.arange(n) - dx * (s - s[0])) / length))
    return float(min(0.5, max(1e-6, max(1, far) / n)))


def mixture(scores, steps: int = 20) -> float:
    """The share of the upper of two normal components."""
    x = np.asarray(scores, float)
    if len(x) < 2:
        return 1e-6
    mid = float(np.percentile(x, 50))
    low, high = x[x <= mid], x[x > mid]
    mu = np.array([low.mean() if len(low) else mid - 1, high.mean() if len(high) else mid + 1])
    var = np.maximum([low.var() if len(low) else 1.0, high.var() if len(high) else 1.0], 1e-8)
    share = 0.5
    for _ in range(steps):
        log = -0.5 * (x[:, None] - mu) ** 2 / var - 0.5 * np.log(var) + np.log(np.maximum([1 - share, share], 1e-10))
        g1 = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        g = np.stack([1 - g1, g1], 1)
        mass = g.sum(0)
        if (mass < 1e-8).any():
            break
        mu = (g * x[:, None]).sum(0) / mass
        var = np.maximum((g * (x[:, None] - mu) ** 2).sum(0) / mass, 1e-8)
        share = float(mass[1] / len(x))
    return float(min(0.5, max(1e-6, share if mu[1] >= mu[0] else 1 - share)))
