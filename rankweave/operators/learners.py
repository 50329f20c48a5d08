"""Models fitted on (score, label) rows: calibrators, transforms and fusion weights.

Fits are plain gradient descent with the given rate and number of steps, since where it stops
is part of the result. Each step is a few numpy sums; :func:`fit_by_group` runs a fit per
group of a DataFrame, one task a group, and predictions are Column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

EPS = X.EPSILON


def sigmoid(x):
    x = np.asarray(x, float)
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def safe(p):
    return np.clip(p, EPS, 1 - EPS)


def logit(p):
    c = safe(np.asarray(p, float))
    return np.log(c / (1 - c))


def descend(theta: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], rate: float, steps: int, tol: float) -> np.ndarray:
    """Until no parameter moves by ``tol``, the last move included, or ``steps`` are done."""
    for _ in range(steps):
        move = rate * gradient(theta)
        theta = theta - move
        if np.abs(move).max(initial=0.0) < tol:
            break
    return theta


class Online:
    """State of an online learner: smoothed, corrected, clipped and decaying gradient steps."""

    def __init__(self, start: np.ndarray):
        self.theta, self.ema, self.mean, self.n = start.astype(float), np.zeros_like(start, float), start.astype(float), 0

    def step(self, gradient: np.ndarray, rate: float, momentum: float, tau: float, clip: float) -> None:
        self.ema = momentum * self.ema + (1 - momentum) * gradient
        self.n += 1
        g = self.ema / (1 - momentum**self.n)
        size = math.sqrt(float((g * g).sum()))
        if size > clip:
            g = g * (clip / size)
        self.theta = self.theta - rate / (1 + self.n / tau) * g

    def average(self, decay: float, value: np.ndarray | None = None) -> None:
        self.mean = decay * self.mean + (1 - decay) * (self.theta if value is None else value)


# --- calibrators ---------------------------------------------------------------------------


@dataclass
class Platt:
    a: float = 1.0
    b: float = 0.0

    def fit(self, scores, labels, rate: float = 0.01, steps: int = 1000, tol: float = 1e-6, weights=None) -> Platt:
        """Each row counts once, or ``weights`` times."""
        m = min(len(scores), len(labels))
        s, y = np.asarray(scores, float)[:m], np.asarray(labels, float)[:m]
        w = None if weights is None else np.asarray(weights, float)[:m]
        n = len(scores) if w is None else float(w.sum())

        def gradient(t):
            error = safe(sigmoid(t[0] * s + t[1])) - y
            if w is not None:
                error = error * w
            return np.array([(error * s).sum(), error.sum()]) / n

        if n:
            self.a, self.b = map(float, descend(np.array([self.a, self.b]), gradient, rate, steps, tol))
        return self

    def calibrate(self, scores):
        return sigmoid(self.a * np.asarray(scores, float) + self.b)

    def column(self, score: Column) -> Column:
        return X.sigmoid(score * self.a + self.b)


def pooled(blocks: Iterable[list[float]]) -> list[list[float]]:
    """Adjacent blocks [sum, count, first score, last score] of falling means joined."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][0] / out[-2][1] > out[-1][0] / out[-1][1]:
            last = out.pop()
            out[-1][0] += last[0]
            out[-1][1] += last[1]
            out[-1][3] = last[3]
    return out


def thinned(blocks: list[list[float]]) -> list[list[float]]:
    """Of equal neighbours the first, the last and one of all between, which changes neither pooling nor interpolation."""
    out: list[list[float]] = []
    for b in blocks:
        mean = b[0] / b[1]
        if len(out) > 2 and all(x[0] / x[1] == mean for x in out[-3:]):
            last, mid = out[-1], out[-2]
            out[-2:] = [[mid[0] + last[0], mid[1] + last[1], mid[2], last[3]], list(b)]
        else:
            out.append(list(b))
    return out


def isotonic_blocks(rows: DataFrame, score: str, label: str, order: list[str]) -> DataFrame:
    """(part, nth, total, n, low, high): the rows pooled within ranges of their score, for :meth:`Isotonic.of_blocks`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: list[list[float]] = []
        for p in parts:
            have = thinned(pooled([*have, *([y, 1.0, s, s] for s, y in zip(p[score].tolist(), p[label].tolist(), strict=True))]))
        if have:
            yield pd.DataFrame(have, columns=["total", "n", "low", "high"]).assign(part=TaskContext.get().partitionId(), nth=range(len(have)))[["part", "nth", "total", "n", "low", "high"]]

    keys = [score, *order]
    return rows.select(*keys, label).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(run, "part long, nth long, total double, n double, low double, high double")


@dataclass
class Isotonic:
    x: list[float] | None = None
    y: list[float] | None = None

    def fit(self, scores, labels) -> Isotonic:
        """Adjacent violators are pooled; a block stands at the middle of its scores."""
        if len(scores) != len(labels):
            raise ValueError("one label for each score")
        s, t = np.asarray(scores, float), np.asarray(labels, float)
        order = np.argsort(s, kind="stable")
        blocks = pooled([w, 1.0, v, v] for v, w in zip(s[order].tolist(), t[order].tolist(), strict=True))
        self.x, self.y = [(b[2] + b[3]) / 2 for b in blocks], [b[0] / b[1] for b in blocks]
        return self

    @classmethod
    def of_blocks(cls, blocks: Iterable[list[float]]) -> Isotonic:
        """Fitted on rows that are pooled in part, in the order of their scores."""
        got = thinned(pooled(blocks))
        return cls([(b[2] + b[3]) / 2 for b in got], [b[0] / b[1] for b in got])

    def calibrate(self, scores):
        if self.x is None:
            raise ValueError("not fitted")
        scores = np.asarray(scores, float)
        return np.full(scores.shape, 0.5) if not self.x else np.interp(scores, self.x, self.y)

    def column(self, score: Column) -> Column:
        """Linear between the two points around the score, without Python."""
        if self.x is None:
            raise ValueError("not fitted")
        if not self.x:
            return F.lit(0.5)
        xs, ys = F.array(*map(F.lit, self.x)), F.array(*map(F.lit, self.y))
        at = F.size(F.filter(xs, lambda v: v <= score))
        x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
        return F.when(at == 0, F.lit(self.y[0])).when(at == len(self.x), F.lit(self.y[-1])).otherwise(y0 + (y1 - y0) * (score - x0) / F.when(x1 > x0, x1 - x0))


def composite_prior(tf, ratio):
    tf, ratio = np.asarray(tf, float), np.asarray(ratio, float)
    part = 0.7 * (0.2 + 0.7 * np.minimum(tf / 10, 1)) + 0.3 * (0.3 + 0.6 * (1 - np.minimum(np.abs(ratio - 0.5) * 2, 1)))
    return np.clip(part, 0.1, 0.9)


class Transform:
    """Score to probability by a sigmoid (alpha, beta), a prior and a base rate; batch and online."""

    ALPHA_MIN = 0.01

    def __init__(self, alpha: float = 1.0, beta: float = 0.0, base_rate: float | None = None, half_life: float | None = None):
        if base_rate is not None and not 0 < base_rate < 1:
            raise ValueError("the base rate must lie in (0, 1)")
        self.base_rate, self.half_life, self.time = base_rate, half_life, 0
        self.state = Online(np.array([alpha, beta]))

    @property
    def alpha(self) -> float:
        return float(self.state.theta[0])

    @property
    def beta(self) -> float:
        return float(self.state.theta[1])

    @staticmethod
    def gradient(t, s, y, prior=None, weight=None, n: int | None = None):
        alpha, beta = t
        like = safe(sigmoid(alpha * (s - beta)))
        if prior is None:
            slope = like - y
            part = np.array([s - beta, np.full_like(s, -alpha)])
        else:
            mass = like * prior + (1 - like) * (1 - prior)
            slope = (safe(like * prior / mass) - y) * prior * (1 - prior) / mass**2 * like * (1 - like)
            part = np.array([s - beta, np.full_like(s, -alpha)])
        if weight is not None:
            slope = slope * weight
        return (part * slope).sum(1) / (n or len(s))

    def fit(self, scores, labels, rate: float = 0.01, steps: int = 1000, tol: float = 1e-6, tfs=None, ratios=None, times=None) -> Transform:
        """Prior-aware with ``tfs`` and ``ratios``; with ``times`` and a half-life, old rows weigh less."""
        m = min(len(scores), len(labels))
        s, y = np.asarray(scores, float)[:m], np.asarray(labels, float)[:m]
        prior = None if tfs is None or ratios is None else composite_prior(tfs, ratios)[:m]
        weight = None
        if times is not None and self.half_life:
            age = np.maximum(0.0, np.max(np.asarray(times, float), initial=0.0)) - np.asarray(times, float)
            weight = np.exp(-math.log(2) / self.half_life * age)
            weight = (weight * len(weight) / weight.sum())[:m]
        if m:
            self.state = Online(descend(self.state.theta, lambda t: self.gradient(t, s, y, prior, weight, len(scores)), rate, steps, tol))
        return self

    def update(self, scores, labels, rate: float = 0.01, momentum: float = 0.9, tau: float = 1000, clip: float = 1.0, decay: float = 0.995, tfs=None, ratios=None) -> Transform:
        s, y = np.atleast_1d(np.asarray(scores, float)), np.atleast_1d(np.asarray(labels, float))
        prior = None if tfs is None or ratios is None else composite_prior(tfs, ratios)
        if self.half_life:
            self.time += 1
            decay = decay * (1 - 1 / (1 + self.time))
        self.state.step(self.gradient(self.state.theta, s, y, prior), rate, momentum, tau, clip)
        self.state.theta[0] = max(self.state.theta[0], self.ALPHA_MIN)
        self.state.average(decay)
        return self

    def column(self, score: Column, tf: Column, ratio: Column, prior: Callable[[Column, Column, Column], Column] | None = None, prior_free: bool = False) -> Column:
        """With the composite prior, a prior of the caller's own (score, tf, ratio), or 0.5 throughout."""
        if prior is None and not prior_free:
            return X.score_to_probability(score, tf, ratio, self.alpha, self.beta, self.base_rate)
        given = F.lit(0.5) if prior_free else prior(score, tf, ratio)
        return X.posterior(X.likelihood(score, self.alpha, self.beta), given, self.base_rate)


def learn_parameters(scores, labels, rate: float = 0.01, steps: int = 1000, tol: float = 1e-6) -> dict:
    """alpha, beta, the loss before each step (and the last), and whether it settled."""
    s, y = np.asarray(scores, float), np.asarray(labels, float)
    t, losses = np.array([1.0, 0.0]), []

    def loss(t):
        p = safe(sigmoid(t[0] * (s - t[1])))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for i in range(steps):
        losses.append(loss(t))
        if i and abs(losses[-2] - losses[-1]) < tol:
            return {"alpha": float(t[0]), "beta": float(t[1]), "losses": losses, "converged": True}
        t = t - rate * Transform.gradient(t, s, y)
    return {"alpha": float(t[0]), "beta": float(t[1]), "losses": [*losses, loss(t)], "converged": False}


# --- fusion weights ---------------------------------------------------------------------------


def softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def min_max(x):
    span = x.max(0) - x.min(0)
    return np.where(span < 1e-12, 0.0, (x - x.min(0)) / np.where(span < 1e-12, 1.0, span))


class LearnableWeights:
    """Softmax weights of n signals, joined in log-odds space."""

    def __init__(self, n: int, alpha: float = 0.0, base_rate: float | None = None):
        self.n, self.scale = n, float(n) ** alpha
        self.shift = 0.0 if base_rate is None else float(logit(base_rate))
        self.state = Online(np.zeros(n))
        self.mean = softmax(self.state.theta)

    @property
    def weights(self):
        return softmax(self.state.theta)

    def combine(self, probs, averaged: bool = False):
        return sigmoid(self.scale * (logit(probs) @ (self.mean if averaged else self.weights)) + self.shift)

    def gradient_sum(self, z, x, y):
        w = softmax(z)
        mid = x @ w
        error = sigmoid(self.scale * mid + self.shift) - y
        return (self.scale * error[:, None] * w * (x - mid[:, None])).sum(0)

    def _gradient(self, z, x, y):
        return self.gradient_sum(z, x, y) / len(y)

    def fit(self, probs, labels, rate: float = 0.01, steps: int = 1000, tol: float = 1e-6) -> LearnableWeights:
        x, y = logit(np.asarray(probs, float)), np.asarray(labels, float)
        if x.shape[1] != self.n:
            raise ValueError("one probability for each signal")
        self.state = Online(descend(self.state.theta, lambda z: self._gradient(z, x, y), rate, steps, tol))
        self.mean = self.weights
        return self

    def update(self, probs, labels, rate: float = 0.01, momentum: float = 0.9, tau: float = 1000, clip: float = 1.0, decay: float = 0.995) -> LearnableWeights:
        x, y = np.atleast_2d(logit(np.asarray(probs, float))), np.atleast_1d(np.asarray(labels, float))
        self.state.step(self._gradient(self.state.theta, x, y), rate, momentum, tau, clip)
        self.mean = decay * self.mean + (1 - decay) * self.weights
        return self


def normal_start(n: int, scale: float, seed: int) -> np.ndarray:
    """Normal values of a 64-bit congruential generator, in pairs by Box and Muller."""
    state, out = (seed + 1) & (2**64 - 1), []

    def uniform() -> float:
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        return (state >> 11) / 2**53

    while len(out) < n:
        r, turn = math.sqrt(-2 * math.log(max(uniform(), 1e-15))), 2 * math.pi * uniform()
        out += [r * math.cos(turn) * scale, r * math.sin(turn) * scale]
    return np.array(out[:n])


class AttentionWeights:
    """Weights of n signals by a linear map of query features through a softmax; several heads average."""

    def __init__(self, n: int, features: int, alpha: float = 0.5, normalize: bool = False, seed: int = 0, base_rate: float | None = None):
        if n < 1 or features < 1:
            raise ValueError("at least one signal and one feature")
        self.n, self.k, self.scale, self.normalize = n, features, float(n) ** alpha, normalize
        self.shift = 0.0 if base_rate is None else float(logit(base_rate))
        self.state = Online(np.concatenate([normal_start(n * features, 1 / math.sqrt(features), seed), np.zeros(n)]))

    def _weights(self, features, theta=None):
        t = self.state.theta if theta is None else theta
        return softmax(np.atleast_2d(np.asarray(features, float)) @ t[: self.n * self.k].reshape(self.n, self.k).T + t[self.n * self.k :])

    def logits(self, probs, features, averaged: bool = False):
        """Fused log odds of rows of signals; the last row of features serves all rows beyond it."""
        x = logit(np.atleast_2d(np.asarray(probs, float)))
        w = self._weights(np.asarray(features, float).reshape(-1, self.k), self.state.mean if averaged else None)
        w = w[np.minimum(np.arange(len(x)), len(w) - 1)]
        return self.scale * (w * (min_max(x) if self.normalize else x)).sum(1) + self.shift

    def combine(self, probs, features, averaged: bool = False):
        return sigmoid(self.logits(probs, features, averaged))

    def gradient_sum(self, theta, x, y, q):
        w = self._weights(q, theta)
        mid = (w * x).sum(1)
        g = self.scale * (sigmoid(self.scale * mid + self.shift) - y)[:, None] * w * (x - mid[:, None])
        return np.concatenate([(g.T @ q).ravel(), g.sum(0)])

    def _gradient(self, theta, x, y, q):
        return self.gradient_sum(theta, x, y, q) / len(y)

    def fit(self, probs, labels, features, query_ids=None, rate: float = 0.01, steps: int = 500, tol: float = 1e-6) -> AttentionWeights:
        x, y, q = logit(np.asarray(probs, float).reshape(-1, self.n)), np.asarray(labels, float), np.asarray(features, float).reshape(-1, self.k)
        if self.normalize:
            x = x.copy()
            ids = np.zeros(len(x)) if query_ids is None else np.asarray(query_ids)
            for i in np.unique(ids):
                x[ids == i] = min_max(x[ids == i])
        self.state = Online(descend(self.state.theta, lambda t: self._gradient(t, x, y, q), rate, steps, tol))
        return self

    def update(self, probs, labels, features, rate: float = 0.01, momentum: float = 0.9, tau: float = 1000, clip: float = 1.0, decay: float = 0.995) -> AttentionWeights:
        x, y, q = logit(np.asarray(probs, float).reshape(-1, self.n)), np.atleast_1d(np.asarray(labels, float)), np.asarray(features, float).reshape(-1, self.k)
        if self.normalize and len(x) > 1:
            x = min_max(x)
        self.state.step(self._gradient(self.state.theta, x, y, q), rate, momentum, tau, clip)
        self.state.average(decay)
        return self

    def upper_bounds(self, bounds, features):
        """Fused bounds of signals' bounds, never normalised."""
        keep, self.normalize = self.normalize, False
        try:
            return self.combine(bounds, features)
        finally:
            self.normalize = keep

    def prune(self, probs, features, bounds, threshold: float):
        """(rows whose bound reaches ``threshold``, their fused probabilities)."""
        rows = np.flatnonzero(self.upper_bounds(bounds, features) >= threshold)
        return rows, self.combine(np.asarray(probs, float).reshape(-1, self.n)[rows], np.asarray(features, float).reshape(-1, self.k)[np.minimum(rows, len(np.asarray(features).reshape(-1, self.k)) - 1)]) if len(rows) else np.zeros(0)


@dataclass
class MultiHead:
    n: int
    features: int
    heads: int = 4
    alpha: float = 0.5
    normalize: bool = False
    models: list[AttentionWeights] = field(init=False)

    def __post_init__(self) -> None:
        self.models = [AttentionWeights(self.n, self.features, self.alpha, self.normalize, seed) for seed in range(self.heads)]

    def combine(self, probs, features, averaged: bool = False):
        return sigmoid(np.mean([logit(m.combine(probs, features, averaged)) for m in self.models], axis=0))

    def fit(self, *args, **kw) -> MultiHead:
        for m in self.models:
            m.fit(*args, **kw)
        return self

    def update(self, *args, **kw) -> MultiHead:
        for m in self.models:
            m.update(*args, **kw)
        return self

    def upper_bounds(self, bounds, features):
        return sigmoid(np.mean([logit(m.upper_bounds(bounds, features)) for m in self.models], axis=0))

    def prune(self, probs, features, bounds, threshold: float):
        """As for one head, by the heads' mean bounds."""
        rows = np.flatnonzero(self.upper_bounds(bounds, features) >= threshold)
        q = np.asarray(features, float).reshape(-1, self.features)
        return rows, self.combine(np.asarray(probs, float).reshape(-1, self.n)[rows], q[np.minimum(rows, len(q) - 1)]) if len(rows) else np.zeros(0)


# --- Spark ------------------------------------------------------------------------------------


def fit_by_group(rows: DataFrame, keys: list[str], fit: Callable[[pd.DataFrame], dict], schema: str, order: list[str]) -> DataFrame:
    """One row of parameters for each group of training rows, which are sorted by ``order`` first.

    A group is one model's training set and must fit one task; models fit in parallel.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **fit(pdf)}])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.groupBy(*keys).applyInPandas(one, f"{names}, {schema}")
