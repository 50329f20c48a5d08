"""Fitted scorers against plain Python over all documents, with a candidate depth far below them."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import scoring
from rankweave.operators.base_rate import first_shuffled, shuffled, split_queries
from rankweave.operators.learners import Isotonic, Platt, Transform, composite_prior, safe, sigmoid
from rankweave.plans import learning
from rankweave.plans.learning import scorers
from rankweave.plans.retrieval import Corpus, Options

N, TOP, DEPTH = 60, 5, 3


def corpus(spark, judged_queries=8):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(3, 25)))), rng.normal(size=4).tolist()) for i in range(N)]
    queries = [(i, " ".join(rng.choice(words, 3)), rng.normal(size=4).tolist()) for i in range(8)]
    qrels = [(q, int(d), float(r)) for q in range(judged_queries) for d, r in zip(rng.choice(N, 12, replace=False), rng.integers(0, 3, 12), strict=True)]
    frames = spark.createDataFrame(docs, "doc_id long, text string, embedding array<double>"), spark.createDataFrame(queries, "query_id long, text string, embedding array<double>"), spark.createDataFrame(qrels, "query_id long, doc_id long, relevance double")
    return Corpus(*frames, options=Options(top=TOP, depth=DEPTH))


def best(rows):
    """{query: [(doc, score)]} of the best of (query, doc, score)."""
    out = {}
    for q, d, s in sorted(rows, key=lambda r: (r[0], -round(r[2], 9), r[1])):
        out.setdefault(q, []).append((d, pytest.approx(s, abs=2e-6)))
    return {q: v[:TOP] for q, v in out.items()}


def ranked(df):
    return {q: [(r.doc_id, r.score) for r in rows] for q, rows in by_query(df).items()}


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_first_shuffled():
    for n, k, seed in ((1, 1, 3), (2, 1, 9), (17, 5, 42), (500, 500, 43), (999, 40, 2**32 - 1), (5, 0, 1), (0, 0, 1)):
        assert first_shuffled(n, k, seed).tolist() == shuffled(n, seed)[:k]


@pytest.mark.parametrize("style", ["pytrec", "python-reference"])
def test_sigmoid_by_style(spark, style):
    """Judged pairs, the default descent and terms' posteriors; or all pairs, the longer one and the whole score's."""
    c = corpus(spark)
    c.options = replace(c.options, style=style)
    rows = [r for r in c.sparse().collect()]
    terms = [r for r in scoring.term_scores(c.index, c.queries).collect()]
    rel = {(r.query_id, r.doc_id): r.relevance for r in c.qrels.collect()}
    assert max(sum(r.query_id == q for r in rows) for q in range(8)) > 2 * DEPTH
    for name, (train, rest) in (("bayesian_fitted", (list(range(8)),) * 2), ("bayesian_fitted_split", split_queries(list(range(8)), 0.5, 42))):
        own = [r for r in rows if r.query_id in train and r.bm25 > 0 and (style != "pytrec" or (r.query_id, r.doc_id) in rel)]
        how = (0.01, 1000) if style == "pytrec" else (0.05, 3000)
        t = Transform(1.0, 0.5).fit([r.bm25 for r in own], [float(rel.get((r.query_id, r.doc_id), 0) > 0) for r in own], *how)
        score = {(q, d): 0.0 for q in rest for d in range(N)}
        post = lambda s, prior: (lambda like: like * prior / (like * prior + (1 - like) * (1 - prior)))(float(safe(sigmoid(t.alpha * (s - t.beta)))))  # noqa: B023, E731
        if style == "pytrec":
            for r in terms:
                if r.query_id in rest and r.raw != 0:
                    score[r.query_id, r.doc_id] = 1 - (1 - score[r.query_id, r.doc_id]) * (1 - post(r.raw, float(composite_prior(r.tf, r.ratio)))) ** r.qtf
        else:
            score |= {(r.query_id, r.doc_id): post(r.bm25, float(composite_prior(r.overlap, r.ratio))) for r in rows if r.query_id in rest}
        assert ranked(scorers()[name](c)) == best((q, d, s) for (q, d), s in score.items())


def test_calibrators_see_all_judged_documents(spark):
    c = corpus(spark)
    cos = {(r.query_id, r.doc_id): r.cos for r in c.dense().collect()}
    rel = {(r.query_id, r.doc_id): r.relevance for r in c.qrels.collect()}
    train, rest = split_queries(list(range(8)), 0.5, 42)
    s, y = [], []
    for i, q in enumerate(train):
        judged = [d for d in range(N) if (q, d) in rel]
        others = [d for d in range(N) if (q, d) not in rel]
        n = sum(rel[q, d] > 0 for d in judged)
        drawn = [others[k] for k in shuffled(len(others), 42 + i + 1)[:n]]
        s += [cos[q, d] for d in judged + drawn]
        y += [float(rel.get((q, d), 0) > 0) for d in judged + drawn]
    assert len(s) > 2 * DEPTH * len(train)
    pool = [(r.query_id, r.doc_id) for r in scoring.top_k(c.dense(), DEPTH, "cos").collect() if r.query_id in rest]
    for name, model in (("dense_platt_split", Platt().fit(s, y)), ("dense_isotonic_split", Isotonic().fit(s, y))):
        assert ranked(scorers()[name](c)) == best((q, d, float(model.calibrate([cos[q, d]])[0])) for q, d in pool)


def test_few_pairs_calibrate_nothing(spark):
    c = corpus(spark)
    c.qrels = c.qrels.where("doc_id < 2")
    assert scorers()["dense_platt_split"](c).count() == 0 and scorers()["dense_isotonic_split"](c).count() == 0


def test_vector_probabilities_of_all_documents(spark):
    """Against the plain transform, which has every distance in one place: by gap, by weights, without either, and few documents."""
    from rankweave.operators import binned_probability, dense
    from rankweave.operators.vector_probability import VectorProbability

    rng = np.random.default_rng(11)
    axis = np.eye(3)[0]
    spread = [(axis * a + rng.normal(size=3) * b).tolist() for a, b in [(0.0, 1.0)] * 200]
    near = [(axis + rng.normal(size=3) * 0.02).tolist() for _ in range(30)]
    for docs, weights in ((spread + near, True), ([(np.array([np.cos(t), np.sin(t), 0])).tolist() for t in np.linspace(0, 1.2, 300)], True), ([(np.array([np.cos(t), np.sin(t), 0])).tolist() for t in np.linspace(0, 1.2, 300)], False), (spread[:20] + near[:5], True)):
        frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, embedding array<double>").repartition(3)
        queries = spark.createDataFrame([(0, axis.tolist()), (1, [0.3, 1.0, 0.2])], "query_id long, embedding array<double>")
        cos = {(r.query_id, r.doc_id): r.cos for r in dense.cosines(frame, queries).collect()}
        w = {k: float(rng.uniform(0, 0.9)) for k in cos if rng.random() < 0.4} if weights else {}
        given = spark.createDataFrame([(*k, v) for k, v in w.items()], "query_id long, doc_id long, weight double")
        cand = spark.createDataFrame([(q, d, c) for (q, d), c in cos.items() if d % 3 == 0], "query_id long, doc_id long, cos double")
        got = {(r.query_id, r.doc_id): r.probability for r in binned_probability.vector_probabilities(cand, frame, queries, given).collect()}
        for q in (0, 1):
            d = np.maximum(0, 1 - np.array([cos[q, i] for i in range(len(docs))]))
            want = VectorProbability.background(d).calibrate(d, weights=[w.get((q, i), 0.0) for i in range(len(docs))])
            mine = [got[q, i] for i in range(0, len(docs), 3)]
            np.testing.assert_allclose(mine, want[::3], rtol=0, atol=2e-3)


def test_every_query_is_ranked(spark):
    """More eligible queries than the 2,000 that were ranked before."""
    n = 2_050
    docs = spark.createDataFrame([(i, f"w{i} x", [1.0, float(i)]) for i in range(4)], "doc_id long, text string, embedding array<double>")
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.lit("w1").alias("text"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    qrels = spark.range(n).select(F.col("id").alias("query_id"), F.lit(1).cast("long").alias("doc_id"), F.lit(1.0).alias("relevance"))
    c = Corpus(docs, queries, qrels, options=Options(top=1, depth=2, split=([0, 1], [n - 2, n - 1])))
    assert len(learning._ids(c)) == len(learning._ids(c, False)) == n
    assert learning._given(c) == ([0, 1], [n - 2, n - 1])
    assert scorers()["bayesian_fitted"](c).select("query_id").distinct().count() == n
    assert {r.query_id for r in scorers()["bayesian_attention"](c).select("query_id").distinct().collect()} == set(range(n))
