"""Probabilities from vector distances: a relevant density against the background's."""

from __future__ import annotations

import numpy as np

from .learners import EPS, logit, safe, sigmoid


def pdf(x, mu, sigma):
    s = max(sigma, EPS)
    return np.exp(-0.5 * ((np.asarray(x, float) - mu) / s) ** 2) / (s * np.sqrt(2 * np.pi))


def bandwidth(d, w) -> float:
    """Silverman's rule with the effective number of weighted points."""
    d, w = np.asarray(d, float), np.maximum(np.asarray(w, float), 0)
    if not len(d) or w.sum() < EPS or (w * w).sum() < EPS:
        return EPS
    spread = np.sqrt((w * (d - (w * d).sum() / w.sum()) ** 2).sum() / w.sum())
    return EPS if spread < EPS else max(1.06 * spread * (w.sum() ** 2 / (w * w).sum()) ** -0.2, EPS)


def kernel_density(at, d, w, h: float):
    at, d, w = np.asarray(at, float), np.asarray(d, float), np.maximum(np.asarray(w, float), 0)
    if not len(d) or w.sum() < EPS:
        return np.full(len(at), EPS)
    h = max(h, EPS)
    z = (at[:, None] - d[None, :]) / h
    return np.maximum((np.exp(-0.5 * z * z) @ w) / (h * np.sqrt(2 * np.pi)) / w.sum(), EPS)


class VectorProbability:
    def __init__(self, mu: float = 0.0, sigma: float = 1.0, base_rate: float | None = None):
        if not sigma > 0:
            raise ValueError("sigma must be positive")
        self.mu, self.sigma, self.shift = mu, max(sigma, EPS), 0.0 if base_rate is None else float(logit(base_rate))

    @classmethod
    def background(cls, distances, base_rate: float | None = None) -> VectorProbability:
        d = np.asarray(distances, float)
        return cls(0.0, 1.0, base_rate) if not len(d) else cls(float(d.mean()), max(float(d.std()), EPS), base_rate)

    @staticmethod
    def gap_weights(d, ratio: float = 0.15):
        """1 below the widest gap, if it is wide by share of the span or by its deviation; else None."""
        d = np.asarray(d, float)
        s = np.sort(d)
        if len(s) < 3 or s[-1] - s[0] < EPS:
            return None
        gaps = np.diff(s)
        k = int(gaps.argmax())
        if gaps[k] / (s[-1] - s[0]) < ratio:
            spread = gaps.std()
            if spread < EPS or (gaps[k] - gaps.mean()) / spread <= 2.0:
                return None
        return (d < s[k + 1]).astype(float)

    @staticmethod
    def sharpen(w, temperature: float = 0.05):
        w = np.asarray(w, float)
        e = np.exp((w - w.max()) / max(temperature, EPS)) if len(w) else w
        return e if e.sum() < EPS else e * (np.maximum(w, 0).sum() / e.sum())

    @staticmethod
    def density_weights(d):
        d = np.asarray(d, float)
        return sigmoid(np.median(d) / np.maximum(d, EPS) - 1) if len(d) else d

    def mixture(self, d, w=None, at=None, steps: int = 100, tol: float = 1e-6):
        """The relevant component beside the fixed background, by expectation-maximisation."""
        d = np.asarray(d, float)
        at = d if at is None else np.asarray(at, float)
        if not len(d):
            return np.full(len(at), EPS)
        w = None if w is None else np.maximum(np.asarray(w, float), 0)
        if w is not None and w.sum() > EPS:
            mu = float((w * d).sum() / w.sum())
            sigma, share = float(np.sqrt((w * (d - mu) ** 2).sum() / w.sum())), float(np.clip(w.sum() / len(d), 0.1, 0.9))
        else:
            mu, sigma, share = self.mu - 0.5 * self.sigma, 0.5 * self.sigma, 0.3
        sigma, last = max(sigma, 0.1 * self.sigma, EPS), -np.inf
        for _ in range(steps):
            own = share * pdf(d, mu, sigma)
            total = np.maximum(own + (1 - share) * pdf(d, self.mu, self.sigma), EPS)
            g, like = own / total, float(np.log(total).sum())
            if abs(like - last) < tol or g.sum() < EPS:
                break
            last = like
            mu = float((g * d).sum() / g.sum())
            sigma = max(float(np.sqrt((g * (d - mu) ** 2).sum() / g.sum())), 0.1 * self.sigma, EPS)
            share = float(np.clip(g.sum() / len(d), 0.01, 0.99))
        return np.maximum(pdf(at, mu, sigma), EPS)

    def relevant_density(self, at, d, method: str = "auto", weights=None, prior=None, factor: float = 2.0):
        d = np.asarray(d, float)
        if not len(d):
            return np.full(len(at), EPS)
        has = lambda w: w is not None and np.maximum(np.asarray(w, float), 0).sum() > EPS
        kde = lambda w: kernel_density(at, d, w, bandwidth(d, w) * factor)
        gap = self.gap_weights(d)
        if method == "auto":
            if gap is not None:
                return kde(gap) if len(d) >= 50 else self.mixture(d, gap, at)
            if has(weights):
                return kde(self.sharpen(weights))
            return self.mixture(d, prior if has(prior) else self.density_weights(d), at)
        given = weights if has(weights) else prior if has(prior) else None
        if method == "kde":
            return kde(given if given is not None else gap if gap is not None else self.density_weights(d))
        if method == "gmm":
            return self.mixture(d, given, at)
        raise ValueError(f"unknown method {method}")

    def calibrate(self, at, sample=None, **options):
        at = np.asarray(at, float)
        relevant = self.relevant_density(at, at if sample is None else sample, **options)
        return safe(sigmoid(np.log(np.maximum(relevant, EPS) / np.maximum(pdf(at, self.mu, self.sigma), EPS)) + self.shift))


def ivf_prior(population: float, average: float, gamma: float = 1.0) -> float:
    return float(sigmoid(gamma * (average / max(population, EPS) - 1)))


def knn_prior(kth: float, median: float, gamma: float = 1.0) -> float:
    return float(sigmoid(gamma * (kth / max(median, EPS) - 1)))
