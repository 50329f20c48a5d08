import numpy as np
import pytest

from rankweave.operators.base_rate import elbow, mixture, shuffled, split_queries
from rankweave.operators.learners import AttentionWeights, Isotonic, LearnableWeights, MultiHead, Platt, Transform, learn_parameters
from rankweave.operators.vector_probability import VectorProbability

near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-12)
S, Y = [0, 1, 2, 3, 4, 5, 1.5, 2.5], [0, 0, 0, 1, 1, 1, 0, 1]
P6, PT = np.array([[0.9, 0.2], [0.3, 0.8], [0.6, 0.6]]), np.array([[0.9, 0.2], [0.8, 0.3], [0.2, 0.9], [0.3, 0.85], [0.6, 0.6], [0.1, 0.1]])
L = [1, 1, 0, 0, 1, 0]


def test_transform_fits():
    t = Transform().fit(S, Y, 0.1, 300, 1e-9)
    assert (t.alpha, t.beta) == (near(2.6971170385814007), near(2.2653722058693453))
    t = Transform().fit(S, Y, 0.1, 300, 1e-9, tfs=[1, 2, 3, 4, 5, 6, 2, 3], ratios=[0.5, 0.6, 0.4, 0.5, 0.7, 0.3, 0.5, 0.6])
    assert (t.alpha, t.beta) == (near(0.44083147944281753), near(0.8485936542047038))
    t = Transform(half_life=50).fit([1, 2, 3, 4, 5], [0, 0, 1, 1, 1], 0.1, 300, times=[0, 10, 20, 30, 100])
    assert (t.alpha, t.beta) == (near(2.016854168095304), near(2.3309887014922084))


def test_transform_updates():
    t = Transform()
    for s, y in zip([0.5, 1.5, 2.5, 3.5, 4.5, 0.8, 2.2], [0, 0, 1, 1, 1, 0, 1], strict=True):
        t.update([s], [y], 0.05, 0.9, 1000, 1.0, 0.99)
    assert (t.alpha, t.beta) == (near(0.8889036208928396), near(0.1358545539133367))
    assert t.state.mean.tolist() == [near(0.9947778954543706), near(0.00638928783310959)]


def test_calibrators():
    p = Platt().fit([0, 1, 2, 3, 4, 5], [0, 0, 0, 1, 1, 1], 0.1, 500, 1e-9)
    assert (p.a, p.b) == (near(1.6715903596695518), near(-3.8099773251403506))
    i = Isotonic().fit([1, 2, 3, 4, 5, 6, 7, 8], [0, 0, 1, 0, 1, 1, 0, 1])
    want = [0, 0, 1 / 6, 1 / 3, 0.5666666666666667, 0.6333333333333333, 2 / 3, 0.9166666666666666, 1, 1]
    assert i.calibrate([0.5, 1, 2.5, 3, 4.5, 5.5, 6, 7.5, 8, 9]).tolist() == [near(x) for x in want]
    assert Isotonic().fit([], []).calibrate([1.0]).tolist() == [0.5]
    with pytest.raises(ValueError):
        Isotonic().calibrate([1.0])


def test_isotonic_column(spark):
    i = Isotonic().fit([1, 2, 3, 4, 5, 6, 7, 8], [0, 0, 1, 0, 1, 1, 0, 1])
    xs = [0.5, 1.0, 2.5, 3.0, 4.5, 5.5, 6.0, 7.5, 8.0, 9.0]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", i.column(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == near(float(i.calibrate([r.x])[0]))


def test_weights():
    w = LearnableWeights(2)
    assert float(w.combine([0.7, 0.8])) == near(0.7533939444035329)
    assert float(LearnableWeights(2, base_rate=0.3).combine([0.7, 0.8])) == near(0.566969722017664)
    w.fit(PT, L, 0.1, 300, 1e-9)
    assert w.weights.tolist() == [near(0.9600765354242592), near(0.03992346457574083)]
    o = LearnableWeights(2, alpha=0.5)
    for p, y in zip(PT, L, strict=True):
        o.update(p, y, 0.05, 0.9, 1000, 1.0, 0.99)
    assert o.weights.tolist() == [near(0.5652010672919596), near(0.4347989327080403)]
    assert o.mean.tolist() == [near(0.5023232191689085), near(0.49767678083109146)]


def test_attention():
    a = AttentionWeights(2, 1)
    assert a.state.theta[:2].tolist() == [near(-1.309112609844572), near(-0.07747019738801404)]
    assert a.combine(P6, [2]).tolist() == [near(x) for x in (0.17324111830380645, 0.8471783012957672, 0.6395506228253339)]
    assert a.combine(P6, [1, 2, 3]).tolist() == [near(x) for x in (0.3066737057596664, 0.8471783012957672, 0.6395506228253339)]
    n = AttentionWeights(2, 1, normalize=True)
    assert n.combine(P6, [1, 2, 3]).tolist() == [near(x) for x in (0.5791932517455811, 0.786379216203838, 0.7121547714324902)]
    assert AttentionWeights(2, 1, base_rate=0.3).combine(P6, [1, 2, 3]).tolist() == [near(x) for x in (0.15935778364019107, 0.7037754264034133, 0.43195392512121045)]
    f = AttentionWeights(2, 1).fit(PT, L, [1, 2, 1, 3, 2, 1], rate=0.1, steps=200, tol=1e-9)
    assert f.state.theta[:2].tolist() == [near(-0.02440829406728749), near(-1.3621745131652974)]
    bounds = [[0.95, 0.9], [0.4, 0.5], [0.2, 0.1]]
    assert a.upper_bounds(bounds, [1, 2, 3]).tolist() == [near(x) for x in (0.9659753078431653, 0.48875258984295145, 0.04395923042257615)]
    rows, fused = a.prune(P6, [1, 2, 3], bounds, 0.5)
    assert rows.tolist() == [0] and fused.tolist() == [near(0.3066737057596664)]
    m = MultiHead(2, 1)
    assert float(m.combine([0.8, 0.9], [1])[0]) == near(0.9309750690031595)
    assert m.combine(P6, [1, 2, 3]).tolist() == [near(x) for x in (0.567989588889615, 0.6200935073782734, 0.6395506228253339)]


def test_base_rates():
    assert sorted(shuffled(9, 42)) == list(range(9))
    train, rest = split_queries(list(range(4)), 0.5, 42)
    assert len(train) == len(rest) == 2 and not set(train) & set(rest)
    assert elbow([]) == mixture([]) == 1e-6
    assert learn_parameters([0, 1, 2, 3], [0, 0, 1, 1], 0.1, 50)["losses"][0] > learn_parameters([0, 1, 2, 3], [0, 0, 1, 1], 0.1, 50)["losses"][-1]


def test_vector_probability():
    d, w = [0.05, 0.08, 0.12, 0.2, 0.8, 0.95, 1.1, 1.25], [1, 1, 0.9, 0.7, 0.05, 0.02, 0.01, 0.01]
    v = VectorProbability.background(d, 0.2)
    p = v.calibrate([0.07, 0.4, 1.15], d, method="kde", weights=w, factor=1.2)
    assert ((p > 0) & (p < 1)).all() and p[0] > p[1] > p[2]
    assert VectorProbability().relevant_density([1.0], []).tolist() == [1e-10]
