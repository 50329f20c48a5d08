"""Scalar functions of the engine: Column in, Column out, all in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def _c(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def sigmoid(x: Column) -> Column:
    """Stable at both ends: exp overflows to infinity and the quotient to 0. The argument stands
    once, so nested calls stay small in generated code."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def clamp(x: Column, low: float, high: float, keep_nan: bool = False) -> Column:
    """``keep_nan`` lets NaN through, which Spark else takes for the largest number."""
    x = _c(x)
    out = F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))
    return F.when(F.isnan(x), x).otherwise(out) if keep_nan else out


def safe_prob(p: Column) -> Column:
    return clamp(p, EPSILON, 1.0 - EPSILON)


def safe_log(p: Column) -> Column:
    return F.log(F.greatest(_c(p), F.lit(EPSILON)))


def logit(p: Column) -> Column:
    c = safe_prob(p)
    return F.log(c / (1.0 - c))


def softplus(x: Column) -> Column:
    x = _c(x)
    return F.when(x > 50, x).when(x < -50, F.exp(x)).otherwise(F.log1p(F.exp(F.least(x, F.lit(50.0)))))


def gate(x: Column, kind: str = "none") -> Column:
    """A log-odds value through a gate: none, relu, swish, swish_b2, gelu or softplus."""
    x = _c(x)
    if kind == "none":
        return x
    if kind == "relu":
        return F.greatest(x, F.lit(0.0))
    if kind == "softplus":
        return softplus(x)
    slope = {"swish": 1.0, "swish_b2": 2.0, "gelu": 1.702}[kind]
    return x * sigmoid(x * slope)


def prob_not(p: Column) -> Column:
    return safe_prob(1.0 - safe_prob(p))


def prob_and(ps: Sequence[Column]) -> Column:
    return F.exp(sum((F.log(safe_prob(p)) for p in ps), F.lit(0.0)))


def prob_or(ps: Sequence[Column]) -> Column:
    return 1.0 - F.exp(sum((F.log(1.0 - safe_prob(p)) for p in ps), F.lit(0.0)))


def check_weights(weights: Sequence[float], n: int) -> None:
    if len(weights) != n:
        raise ValueError("one weight for each signal")
    if any(w < 0 for w in weights):
        raise ValueError("weights may not be negative")
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")


def log_odds_conjunction(ps: Sequence[Column], alpha: float | None = None, weights: Sequence[float] | None = None, gating: str = "none") -> Column:
    """Signals joined in log-odds space: gated logits averaged, or weighed, and scaled by n**alpha.

    Without signals 0.5. ``alpha`` is 0.5 for the plain mean and 0 with weights.
    """
    n = len(ps)
    if n == 0:
        return F.lit(0.5)
    logits = [gate(logit(p), gating) for p in ps]
    if weights is None:
        return sigmoid(sum(logits[1:], logits[0]) / n * float(n) ** (0.5 if alpha is None else alpha))
    check_weights(weights, n)
    total = sum((w * x for w, x in zip(weights, logits, strict=True)), F.lit(0.0))
    return sigmoid(total * float(n) ** (0.0 if alpha is None else alpha))


def cosine_to_probability(s: Column) -> Column:
    """Kept inside (0, 1), for log odds."""
    return safe_prob((1.0 + _c(s)) / 2.0)


def vector_probability(s: Column) -> Column:
    """Kept inside [0, 1] only."""
    return clamp((1.0 + _c(s)) / 2.0, 0.0, 1.0)


def cosine_distance(s: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - clamp(s, -1.0, 1.0))


def gaussian_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    s = F.greatest(_c(sigma), F.lit(EPSILON))
    z = (_c(x) - _c(mu)) / s
    return F.exp(-0.5 * z * z) / (s * float((2 * 3.141592653589793) ** 0.5))


def log_add_exp(a: Column, b: Column) -> Column:
    m = F.greatest(a, b)
    return m + F.log(F.exp(a - m) + F.exp(b - m))


# --- vectors ------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Over the shorter vector's length, left to right."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either norm is (nearly) 0, so for empty vectors too."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na < EPSILON) | (nb < EPSILON), 0.0).otherwise(dot(a, b) / (na * nb))


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


# --- probabilities from scores --------------------------------------------------------------


def likelihood(score: Column, alpha: float = 1.0, beta: float = 0.5) -> Column:
    return sigmoid(alpha * (_c(score) - beta))


def tf_prior(tf: Column) -> Column:
    return 0.2 + 0.7 * F.least(_c(tf) / 10.0, F.lit(1.0))


def norm_prior(ratio: Column) -> Column:
    return 0.3 + 0.6 * (1.0 - F.least(F.abs(_c(ratio) - 0.5) * 2.0, F.lit(1.0)))


def composite_prior(tf: Column, ratio: Column) -> Column:
    return clamp(0.7 * tf_prior(tf) + 0.3 * norm_prior(ratio), 0.1, 0.9)


def posterior(like: Column, prior: Column, base_rate: float | None = None, safe: bool = True) -> Column:
    """Bayes' rule, and once more with a base rate; ``safe`` keeps each step inside (0, 1)."""

    def step(p: Column, q: Column) -> Column:
        out = p * q / (p * q + (1.0 - p) * (1.0 - q))
        return safe_prob(out) if safe else out

    p = step(safe_prob(like), safe_prob(prior))
    return p if base_rate is None else step(p, F.lit(float(base_rate)))


def score_to_probability(score: Column, tf: Column, ratio: Column, alpha: float = 1.0, beta: float = 0.0, base_rate: float | None = None) -> Column:
    return posterior(likelihood(score, alpha, beta), composite_prior(tf, ratio), base_rate)


def wand_upper_bound(bound: Column, alpha: float = 1.0, beta: float = 0.0, base_rate: float | None = None, p_max: float = 0.9) -> Column:
    return posterior(likelihood(bound, alpha, beta), F.lit(p_max), base_rate)
