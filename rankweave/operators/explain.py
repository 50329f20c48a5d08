"""Traces: every intermediate of a score as a struct column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import exprs as X


def trace_bm25(score: Column, tf: Column, ratio: Column, alpha: float = 1.0, beta: float = 0.5, base_rate: float | None = None) -> Column:
    like, prior = X.likelihood(score, alpha, beta), X.composite_prior(tf, ratio)
    return F.struct(
        score.alias("raw"), like.alias("likelihood"), X.tf_prior(tf).alias("tf_prior"), X.norm_prior(ratio).alias("norm_prior"), prior.alias("prior"),
        X.logit(like).alias("logit_likelihood"), X.logit(prior).alias("logit_prior"), X.posterior(like, prior, base_rate).alias("posterior"),
    )


def trace_vector(cos: Column) -> Column:
    p = X.cosine_to_probability(cos)
    return F.struct(cos.alias("cosine"), p.alias("probability"), X.logit(p).alias("logit"))


def trace_not(p: Column) -> Column:
    return F.struct(p.alias("probability"), X.prob_not(p).alias("complement"))


def trace_fusion(names: list[str], ps: list[Column], method: str = "log_odds", alpha: float | None = None, weights: list[float] | None = None) -> Column:
    fused = {
        "log_odds": lambda: X.log_odds_conjunction(ps, alpha, weights),
        "prob_and": lambda: X.prob_and(ps),
        "prob_or": lambda: X.prob_or(ps),
        "prob_not": lambda: X.prob_and([1.0 - X.safe_prob(p) for p in ps]),
    }
    if method not in fused:
        raise ValueError(f"unknown method {method}")
    signals = F.array(*(F.struct(F.lit(n).alias("name"), p.alias("probability"), X.logit(p).alias("logit")) for n, p in zip(names, ps, strict=True)))
    return F.struct(F.lit(method).alias("method"), signals.alias("signals"), fused[method]().alias("fused"))


def trace_document(bm25: Column | None = None, tf: Column | None = None, ratio: Column | None = None, cos: Column | None = None, method: str = "log_odds", alpha: float | None = None, weights: list[float] | None = None) -> Column:
    """The traces of a document's signals, of their fusion, and the final probability; at least one signal is needed."""
    if bm25 is None and cos is None:
        raise ValueError("bm25 or cos is needed")
    if bm25 is not None and (tf is None or ratio is None):
        raise ValueError("bm25 needs tf and ratio")
    traces = ({"BM25": trace_bm25(bm25, tf, ratio)} if bm25 is not None else {}) | ({"Vector": trace_vector(cos)} if cos is not None else {})
    ps = [t["posterior" if n == "BM25" else "probability"] for n, t in traces.items()]
    fusion = trace_fusion(list(traces), ps, method, alpha, weights)
    return F.struct(F.struct(*(t.alias(n) for n, t in traces.items())).alias("signals"), fusion.alias("fusion"), fusion["fused"].alias("probability"))


def compare(names: list[str], a: list[Column], b: list[Column], fused_a: Column, fused_b: Column) -> Column:
    """Differences by signal (a missing one is 0.5), the first of the largest, and the first that opposes the whole."""
    deltas = [F.coalesce(x, F.lit(0.5)) - F.coalesce(y, F.lit(0.5)) for x, y in zip(a, b, strict=True)]
    largest = F.greatest(*(F.abs(d) for d in deltas)) if len(deltas) > 1 else F.abs(deltas[0])
    whole = fused_a - fused_b
    dominant, crossing = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, d in reversed(list(zip(names, deltas, strict=True))):
        dominant = F.when(F.abs(d) == largest, n).otherwise(dominant)
        crossing = F.when(d * whole < 0, n).otherwise(crossing)
    return F.struct(whole.alias("delta"), F.struct(*(d.alias(n) for n, d in zip(names, deltas, strict=True))).alias("signals"), dominant.alias("dominant"), crossing.alias("crossover"))
