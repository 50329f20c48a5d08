"""Descents over dealt-out rows against the same descents in numpy."""

import numpy as np
import pytest

from rankweave.operators import gradients
from rankweave.operators.gradients import fit_attention, fit_learnable, fit_sigmoid
from rankweave.operators.learners import AttentionWeights, LearnableWeights, MultiHead, Transform

FEATURES = ["f0", "f1", "f2"]


def training(rng, models=3, queries=9, rows=14):
    out = []
    for m in range(models):
        for q in range(queries):
            f = rng.normal(size=3).tolist()
            for d in range(int(rng.integers(3, rows))):
                a, b = rng.uniform(0.01, 0.99, 2)
                out.append((m, q, d, float(a), float(b), float(rng.random() < a), *f))
    return out + [(7, 1, d, 0.5, 0.5, 1.0, *[0.0] * 3) for d in range(20)] + [(8, 1, 1, 0.2, 0.4, 1.0, *[0.0] * 3), (8, 1, 2, 0.2, 0.4, 0.0, *[0.0] * 3)]


@pytest.fixture(scope="module")
def rows(spark):
    data = training(np.random.default_rng(4))
    return data, spark.createDataFrame(data, "model int, query_id long, doc_id long, a double, b double, label double, f0 double, f1 double, f2 double").repartition(5)


@pytest.mark.parametrize(("normalize", "heads"), [(False, 1), (True, 1), (True, 4)])
def test_attention(rows, normalize, heads):
    data, frame = rows
    make = lambda: MultiHead(2, 3, heads, 0.5, normalize).models
    got = fit_attention(frame, ["a", "b"], FEATURES, make(), steps=40)
    assert sorted(got) == [0, 1, 2]  # model 7 has one class, model 8 too few rows
    for m, thetas in got.items():
        own = np.array(sorted(r for r in data if r[0] == m))
        for one, theta in zip(make(), thetas, strict=True):
            assert isinstance(one, AttentionWeights)
            want = one.fit(own[:, 3:5], own[:, 5], own[:, 6:], own[:, 1], steps=40).state.theta
            np.testing.assert_allclose(theta, want, rtol=0, atol=1e-9)


def test_learnable(rows):
    data, frame = rows
    got = fit_learnable(frame, ["a", "b"])
    for m in (0, 1, 2, 7):
        own = np.array([r for r in data if r[0] == m])
        np.testing.assert_allclose(got[m], LearnableWeights(2).fit(own[:, 3:5], own[:, 5], 0.1, 300, 1e-9).weights, rtol=0, atol=1e-9)


@pytest.mark.parametrize(("aware", "half_life"), [(False, None), (True, None), (False, 4.0), (True, 4.0)])
def test_sigmoid(rows, aware, half_life):
    data, frame = rows
    named = frame.withColumnsRenamed({"a": "score", "b": "ratio"}).selectExpr("*", "cast(doc_id as double) tf", "cast(query_id as double) time")
    got = fit_sigmoid(named, aware=aware, half_life=half_life, rate=0.1, steps=60)
    for m in (0, 1, 2):
        own = np.array([r for r in data if r[0] == m])
        t = Transform(1.0, 0.0, half_life=half_life)
        t.fit(own[:, 3], own[:, 5], 0.1, 60, 1e-6, tfs=own[:, 2] if aware else None, ratios=own[:, 4] if aware else None, times=own[:, 1] if half_life else None)
        assert got[m] == (len(own), pytest.approx(t.alpha, abs=1e-9), pytest.approx(t.beta, abs=1e-9))


@pytest.mark.parametrize("normalize", [False, True])
def test_a_job_for_each_step(rows, monkeypatch, normalize):
    """Above the bound the steps are jobs; the models are the same."""
    make = lambda: MultiHead(2, 3, 2, 0.5, normalize).models
    near = fit_attention(rows[1], ["a", "b"], FEATURES, make(), steps=6)
    monkeypatch.setattr(gradients, "LOCAL", 10)
    far = fit_attention(rows[1], ["a", "b"], FEATURES, make(), steps=6)
    assert sorted(near) == sorted(far) == [0, 1, 2]
    for m in near:
        np.testing.assert_allclose(near[m], far[m], rtol=0, atol=1e-12)


def test_no_rows(rows):
    assert fit_learnable(rows[1].where("false"), ["a", "b"]) == {}
