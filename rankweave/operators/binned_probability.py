"""Vector probabilities from all documents' distances, which reach a task as bins only.

The plain transform (:mod:`vector_probability`) needs every distance of a query in one place. Bins with
their number, sums and range merge across tasks, and all that the transform asks of the distances is
taken from them:

* mean, deviation and bandwidth: exact, from the sums;
* the widest gap: between the range of one bin and the next, exact wherever it is wider than a bin,
  since no gap inside a bin can be wider than that; the deviation of the gaps takes those inside a bin as equal;
* densities and expectation-maximisation: a bin stands at its mean, which moves a density by no more than
  (bin width / bandwidth)^2 / 8 of the kernel's height, for the mean of the kernel's curvature is bounded by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .dense import BINS, COUNTS, cosine_pieces, distance_bins, passes
from .learners import EPS, safe, sigmoid
from .packed import Packed
from .vector_probability import VectorProbability, pdf

TEMPERATURE = 0.05
FACTOR = 2.0


class Bins:
    """One query's bins in the order of their distance, with the sums of the sharpened weights in each."""

    def __init__(self, p: pd.DataFrame):
        p = p.sort_values("bin")
        get = lambda c: p[c].to_numpy(float)
        self.n, self.d1, self.d2, self.low, self.high = (get(c) for c in ("n", "d1", "d2", "low", "high"))
        most = max(0.0, float(p.most.max()))  # the largest weight, 0 of a document without a match
        self.weighted = bool(get("w1").sum() > EPS)
        rest, none = self.n - get("m"), np.exp(-most / TEMPERATURE)
        up = np.exp((1.0 - most) / TEMPERATURE)
        self.w0 = get("e") * up + rest * none
        self.ww = get("ee") * up * up + rest * none * none
        self.w1 = get("ed") * up + (self.d1 - get("m1")) * none
        self.w2 = get("edd") * up + (self.d2 - get("m2")) * none
        self.at = self.d1 / self.n

    def gap(self, ratio: float = 0.15) -> np.ndarray | None:
        """Which bins lie below the widest gap, if it is wide by share of the span or by its deviation."""
        total, span = self.n.sum(), self.high[-1] - self.low[0]
        if total < 3 or span < EPS:
            return None
        gaps = self.low[1:] - self.high[:-1]
        if not len(gaps):
            return None
        k = int(gaps.argmax())
        if gaps[k] / span < ratio:
            inside = np.where(self.n > 1, (self.high - self.low) ** 2 / np.maximum(self.n - 1, 1), 0.0)
            mean = span / (total - 1)
            spread = np.sqrt(max(0.0, ((gaps * gaps).sum() + inside.sum()) / (total - 1) - mean * mean))
            if spread < EPS or (gaps[k] - mean) / spread <= 2.0:
                return None
        return np.arange(len(self.n)) <= k


def _kernel(at: np.ndarray, centre: np.ndarray, w: np.ndarray, sums: tuple[float, float, float, float]) -> np.ndarray:
    """Density at ``at`` of weights ``w`` that stand at ``centre``; sums of w, w * d, w * d^2 and w^2 give the bandwidth."""
    s0, s1, s2, ss = sums
    if s0 < EPS:
        return np.full(len(at), EPS)
    spread = np.sqrt(max(0.0, s2 / s0 - (s1 / s0) ** 2)) if ss >= EPS else 0.0
    h = max((EPS if spread < EPS else max(1.06 * spread * (s0 * s0 / ss) ** -0.2, EPS)) * FACTOR, EPS)
    out = np.empty(len(at))
    for lo in range(0, len(at), 64):
        z = (at[lo : lo + 64, None] - centre[None, :]) / h
        out[lo : lo + 64] = np.exp(-0.5 * z * z) @ w
    return np.maximum(out / (h * np.sqrt(2 * np.pi)) / s0, EPS)


def _mixture(at: np.ndarray, b: Bins, w: np.ndarray, background: VectorProbability, steps: int = 100, tol: float = 1e-6) -> np.ndarray:
    """The relevant component beside the background; ``w`` is each bin's mean weight of a document."""
    d, n = b.at, b.n
    if (w * n).sum() > EPS:
        s = (w * n).sum()
        mu = float((w * n * d).sum() / s)
        sigma, share = float(np.sqrt((w * n * (d - mu) ** 2).sum() / s)), float(np.clip(s / n.sum(), 0.1, 0.9))
    else:
        mu, sigma, share = background.mu - 0.5 * background.sigma, 0.5 * background.sigma, 0.3
    sigma, last = max(sigma, 0.1 * background.sigma, EPS), -np.inf
    for _ in range(steps):
        own = share * pdf(d, mu, sigma)
        total = np.maximum(own + (1 - share) * pdf(d, background.mu, background.sigma), EPS)
        g, like = n * own / total, float((n * np.log(total)).sum())
        if abs(like - last) < tol or g.sum() < EPS:
            break
        last = like
        mu = float((g * d).sum() / g.sum())
        sigma = max(float(np.sqrt((g * (d - mu) ** 2).sum() / g.sum())), 0.1 * background.sigma, EPS)
        share = float(np.clip(g.sum() / n.sum(), 0.01, 0.99))
    return np.maximum(pdf(at, mu, sigma), EPS)


def calibrated(at: np.ndarray, b: Bins, base_rate: float | None = None) -> np.ndarray:
    """Probabilities of the distances ``at``: by the widest gap, else the sharpened weights, else near distances."""
    n = b.n.sum()
    mu = b.d1.sum() / n
    back = VectorProbability(mu, max(float(np.sqrt(max(0.0, b.d2.sum() / n - mu * mu))), EPS), base_rate)
    gap = b.gap()
    if gap is not None and n >= 50:
        w = np.where(gap, b.n, 0.0)
        dens = _kernel(at, b.at, w, (w.sum(), b.d1[gap].sum(), b.d2[gap].sum(), w.sum()))
    elif gap is not None:
        dens = _mixture(at, b, gap.astype(float), back)
    elif b.weighted:
        centre = np.where(b.w0 > 0, b.w1 / np.maximum(b.w0, 1e-300), b.at)
        dens = _kernel(at, centre, b.w0, (b.w0.sum(), b.w1.sum(), b.w2.sum(), b.ww.sum()))
    else:
        order = np.cumsum(b.n)
        middle = [b.at[np.searchsorted(order, k, "right")] for k in ((n - 1) // 2, n // 2)]
        dens = _mixture(at, b, sigmoid(np.mean(middle) / np.maximum(b.at, EPS) - 1), back)
    return safe(sigmoid(np.log(np.maximum(dens, EPS) / np.maximum(pdf(at, back.mu, back.sigma), EPS)) + back.shift))


def _weight_bins(weights: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """By query and bin of weights(query_id, doc_id, weight): number, sums of distances, and of sharpened weights with them."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    rows = weights.join(q, "query_id").join(docs.select("doc_id", "embedding"), "doc_id")
    d = X.cosine_distance(X.cosine(F.col("q"), F.coalesce("embedding", F.array().cast("array<float>"))))
    rows = rows.select("query_id", d.alias("d"), F.greatest("weight", F.lit(0.0)).alias("w"), F.col("weight"))
    e = F.exp((F.col("weight") - 1.0) / TEMPERATURE)
    rows = rows.select("query_id", F.floor(F.col("d") * BINS).alias("bin"), "d", "w", "weight", e.alias("s"))
    d, s = F.col("d"), F.col("s")
    return rows.groupBy("query_id", "bin").agg(F.count("*").cast("double").alias("m"), F.sum("d").alias("m1"), F.sum(d * d).alias("m2"), F.sum("w").alias("w1"), F.max("weight").alias("most"), F.sum("s").alias("e"), F.sum(s * s).alias("ee"), F.sum(s * d).alias("ed"), F.sum(s * d * d).alias("edd"))


_SUMMED = ("m", "m1", "m2", "w1", "e", "ee", "ed", "edd")


def _packed_bins(packed: Packed, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """As :func:`_weight_bins`, the Bayesian scores of the packed documents the weights: a task adds its matches up by query
    and bin, so no row stands for a match."""
    m, width = packed.model, 2 * BINS + 1
    number = {q: i for i, q in enumerate(m.asked.ids)}

    def of(ids: list, q: np.ndarray):
        asks = np.array([i for i, x in enumerate(ids) if x in number], np.int64)  # rows of q that ask for a term
        asked = np.array([number[ids[i]] for i in asks], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, most = np.zeros((8, len(q) * width)), np.full(len(q) * width, -np.inf)
            for whole, cos in cosine_pieces(batches, q):
                lo = 0
                for b in m.pieces([whole]):
                    row, t, tf, ratio = m.postings(b.column("doc_len").to_numpy(), b.column("term"), b.column("tf"))
                    hit, (miss,) = m.sums(row, t, [m.part("bayes", t, tf, ratio)], b.num_rows)
                    doc, i = np.nonzero(hit[:, asked])
                    w, d = 1.0 - np.exp(miss[doc, asked[i]]), np.maximum(0.0, 1.0 - np.clip(cos[asks[i], lo + doc], -1.0, 1.0))
                    s, at = np.exp((w - 1.0) / TEMPERATURE), np.floor(d * BINS).astype(np.int64) + asks[i] * width
                    for total, x in zip(sums, (None, d, d * d, np.maximum(w, 0.0), s, s * s, s * d, s * d * d), strict=True):
                        total += np.bincount(at, weights=x, minlength=len(total))
                    np.maximum.at(most, at, w)
                    lo += b.num_rows
            some = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(some // width), pa.array(some % width), *(pa.array(x[some]) for x in (*sums, most))], names=["q", "bin", *_SUMMED, "most"])

        return run

    vectors = docs.select("doc_id", "embedding").join(packed.docs.select("doc_id", "doc_len", "term", "tf"), "doc_id")
    schema = ", ".join(["q long", "bin long", *(f"{c} double" for c in (*_SUMMED, "most"))])
    rows = passes(vectors, queries, max(1, COUNTS // 2 // width), of, schema, ["doc_len", "term", "tf"])
    return rows.groupBy("query_id", "bin").agg(*(F.sum(c).alias(c) for c in _SUMMED), F.max("most").alias("most"))


def vector_probabilities(candidates: DataFrame, docs: DataFrame, queries: DataFrame, weights: DataFrame | Packed, base_rate: float | None = None) -> DataFrame:
    """(query_id, doc_id, probability) of candidates(query_id, doc_id, cos), bounded for each query.

    Background, gap and density come from all of docs(doc_id, embedding) for queries(query_id, embedding);
    weights(query_id, doc_id, weight) are those of the documents with one, all others weigh 0; or packed documents,
    which weigh their Bayesian scores.
    """
    matched = (_packed_bins if isinstance(weights, Packed) else _weight_bins)(weights, docs, queries)
    bins = distance_bins(docs, queries).join(matched, ["query_id", "bin"], "left").na.fill(0.0, [*_SUMMED, "most"])
    kinds = {f.name: f.dataType.simpleString() for f in candidates.select("query_id", "doc_id").schema}

    def one(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = p[["query_id", "doc_id"]]
        return out.assign(probability=calibrated(np.maximum(0.0, 1.0 - np.clip(p.cos.to_numpy(float), -1.0, 1.0)), Bins(b), base_rate)) if len(p) and len(b) else out.iloc[:0].assign(probability=0.0)

    return candidates.select("query_id", "doc_id", "cos").groupBy("query_id").cogroup(bins.groupBy("query_id")).applyInPandas(one, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, probability double")
