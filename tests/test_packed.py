"""Packed documents against the joins, and the sigmoid from sums by bins against the descent over rows."""

from dataclasses import replace

import numpy as np
import pytest

from rankweave.operators import gradients, packed, scoring
from rankweave.operators.index import Index, Params
from rankweave.operators.learners import Transform
from rankweave.operators.packed import Packed


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{i}" for i in rng.zipf(1.3, n) % 50)
    rows = [(i, words(int(rng.integers(1, 40)))) for i in range(300)] + [(300, None), (301, ""), (7, "w1 w2 w2"), (302, "rare W1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "w1 w2 w2 w9"), (2, "rare w3"), (3, "absent"), (4, None), (5, "w4")], "query_id long, text string")
    return docs, scoring.query_terms(queries)


@pytest.mark.parametrize("method", ["robertson", "lucene"])
@pytest.mark.parametrize("cells", [1 << 20, 7])
def test_packed_equals_joins(spark, tables, monkeypatch, method, cells):
    docs, asked = tables
    monkeypatch.setattr(packed, "CELLS", cells)
    monkeypatch.setattr(packed, "HELD", 10)
    index = Index.build(docs, params=Params(method=method, base_rate=0.1))
    rows, p = scoring.sparse_scores(index, asked), Packed.of(index, asked)
    show = lambda df: [(r.query_id, r.doc_id, r["rank"], pytest.approx(r.s, abs=1e-9)) for r in df.orderBy("query_id", "rank").collect()]
    for score, column in (("bm25", "bm25"), ("bayes", "bayes")):
        for part in (p, p.only([1, 5])):
            want = rows if part is p else rows.where("query_id in (1, 5)")
            assert show(scoring.top_k(part.top(6, score), 6).withColumnRenamed("score", "s")) == show(scoring.top_k(want.withColumnRenamed(column, "score"), 6).withColumnRenamed("score", "s"))
    judged = spark.createDataFrame([(q, d, float(d % 3)) for q in (1, 2, 3, 5) for d in range(0, 310, 7)], "query_id long, doc_id long, relevance double")
    want = {(r.query_id, r.doc_id): (r.bm25, r.relevance) for r in rows.join(judged, ["query_id", "doc_id"]).collect()}
    got = {(r.query_id, r.doc_id): (r.bm25, r.relevance) for r in p.pairs(judged).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_too_many_query_terms_and_no_documents(spark, tables, monkeypatch):
    docs, asked = tables
    assert Packed.of(Index.build(docs.limit(0)), asked).top(3).count() == 0
    monkeypatch.setattr(packed, "ASKED", 2)
    assert Packed.of(Index.build(docs), asked) is None


def test_sigmoid_from_sums_in_a_bounded_number_of_jobs(spark, monkeypatch):
    """More rows than steps are taken locally for: a job a step before."""
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.gamma(3.0, 4.0, 3000), [0.0, 0.001, 90.0]])
    y = (rng.random(len(s)) < 1 / (1 + np.exp(3 - 0.4 * s))).astype(float)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y, strict=True)], "score double, label double").repartition(3)
    monkeypatch.setattr(gradients, "LOCAL", 10)
    for labels in (y, np.ones(len(s))):
        t = Transform(1.0, 0.5).fit(s, labels, 0.01, 1000)
        given = rows if labels is y else rows.selectExpr("score", "1.0D AS label")
        spark.sparkContext.setJobGroup(f"fit{labels[0]}", "")
        n, alpha, beta = gradients.fit_sigmoid_binned(given, start=(1.0, 0.5))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit{labels[0]}")) < 20
        assert n == len(s) and abs(alpha - t.alpha) < 1e-11 and abs(beta - t.beta) < 1e-11
    assert gradients.fit_sigmoid_binned(rows.limit(0), start=(1.0, 0.5)) == (0, 1.0, 0.5)


def test_fitted_query_takes_few_jobs(spark, monkeypatch):
    """The registered scorer's fit on more rows than ``LOCAL``."""
    from rankweave.plans.learning import scorers
    from rankweave.plans.retrieval import Corpus, Options

    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 9, 12)), [1.0]) for i in range(40)], "doc_id long, text string, embedding array<double>")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 3}", [1.0]) for i in range(4)], "query_id long, text string, embedding array<double>")
    qrels = spark.createDataFrame([(q, d, float(d % 2)) for q in range(4) for d in range(40)], "query_id long, doc_id long, relevance double")
    c = Corpus(docs, queries, qrels)
    c.options = replace(Options(), top=3)
    monkeypatch.setattr(gradients, "LOCAL", 10)
    spark.sparkContext.setJobGroup("fitted", "")
    assert scorers()["bayesian_fitted"](c).count() == 12
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fitted")) < 200


def test_texts_are_read_without_their_vectors(spark, tmp_path):
    """The index of the tables joins no vector to a text: no shuffle of texts, no job to count its parts, no text twice for an id of two vectors."""
    from rankweave.plans.retrieval import Corpus

    for name, rows, schema in (
        ("documents", [(1, "w1 w2"), (2, "w2 w3 w3"), (3, None)], "doc_id long, text string"),
        ("embeddings", [(1, [1.0], 0), (1, [0.5], 0), (2, [1.0], 1)], "vec_id long, embedding array<float>, label int"),
        ("benchmark", [(1, "w2")], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    c = Corpus.of_tables(spark, str(tmp_path))
    assert "Join" not in c.index.docs._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(c.index.corpus_stats().first()) == (3.0, 5 / 3)
    best = Packed.of(c.index, c.queries).top(5).orderBy("doc_id").collect()
    assert [(r.query_id, r.doc_id) for r in best] == [(1, 1), (1, 2)]


def test_self_checks_on_packed_postings(spark, tables, monkeypatch):
    """The same verdicts and numbers as from rows by query, without the three joined score tables."""
    from pyspark.sql import functions as F

    from rankweave.operators import selfcheck
    from rankweave.operators.selfcheck import SelfCheck

    docs, asked = tables
    index = Index.build(docs, params=Params(method="lucene"))
    queries = spark.createDataFrame([(1, "w1 w2 w2 w9"), (2, "rare w3"), (3, "absent"), (4, None), (5, "w4 w1")], "query_id long, text string")
    asked = scoring.query_terms(queries)
    signals = scoring.sparse_scores(index, asked).select("query_id", "doc_id", "bm25", "bayes", F.lit(0.3).alias("cos")).persist()
    relevant = spark.createDataFrame([(1, 3), (1, 8)], "query_id long, doc_id long")
    names = ("formula_equivalence", "monotonicity", "prior_bounds", "idf_properties", "base_rate")
    rows = lambda check: [tuple(getattr(check, n)().first()) for n in names]
    plain = rows(SelfCheck(index, queries, signals, relevant))
    assert all(passed and n > 0 for passed, n in plain)
    monkeypatch.setattr(selfcheck, "sparse_scores", lambda *a: pytest.fail("a row for each match"))
    assert rows(SelfCheck(index, queries, signals, relevant, Packed.of(index, asked))) == plain
