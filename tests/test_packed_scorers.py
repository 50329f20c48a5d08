"""Scorers that take their sparse scores from packed documents: the rows of the joins, without a row for each match."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import packed, scoring
from rankweave.operators.index import Params
from rankweave.operators.training import RICH, query_features
from rankweave.plans import learning, retrieval
from rankweave.plans.retrieval import Corpus, Options


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(14)]
    vector = lambda: rng.normal(size=4).tolist()
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(3, 25)))), vector() if i % 5 else None) for i in range(90)] + [(90, None, vector()), (91, "", [0.0] * 4)]
    queries = [(i, " ".join(rng.choice(words, 3)), vector()) for i in range(8)] + [(8, "absent", vector()), (9, "w1 w2", None), (10, None, vector())]
    qrels = [(q, int(d), float(r)) for q in range(9) for d, r in zip(rng.choice(90, 12, replace=False), rng.integers(0, 2, 12), strict=True)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, embedding array<float>").repartition(3).persist(),
        spark.createDataFrame(queries, "query_id long, text string, embedding array<float>"),
        spark.createDataFrame(qrels, "query_id long, doc_id long, relevance double"),
    )


def corpus(frames, **params):
    return Corpus(*frames, params=Params(method="lucene", **params), options=Options(top=5, depth=12))


def rows(df):
    return [(r.query_id, r.doc_id, r["rank"], pytest.approx(r.score, abs=1e-6)) for r in df.orderBy("query_id", "rank").collect()]


def both(monkeypatch, run):
    """What ``run`` gives with packed documents, where a score table of joins is an error, and with joins."""
    with monkeypatch.context() as m:
        m.setattr(scoring, "sparse_scores", lambda *a: pytest.fail("a row for each match"))
        got = run()
    with monkeypatch.context() as m:
        m.setattr(packed, "ASKED", 2)
        want = run()
    assert got and got == want


@pytest.mark.parametrize("vector", [False, True])
def test_attention_rows(frames, monkeypatch, vector):
    """What all attention scorers are fitted on and rank: both probabilities and the features."""
    names = ("query_id", "doc_id", "bayes", "dense", "relevance", *RICH)
    both(monkeypatch, lambda: [tuple(pytest.approx(r[c], abs=1e-6) for c in names) for r in learning._scored(corpus(frames), vector).orderBy("query_id", "doc_id").collect()])


@pytest.mark.parametrize("name", ["bayesian_vector_balanced", "bayesian_vector_softplus"])
def test_vector_scorers(frames, monkeypatch, name):
    both(monkeypatch, lambda: rows(learning.scorers()[name](corpus(frames))))


@pytest.mark.parametrize("name", ["bayesian", "rrf"])
def test_plain_scorers(frames, monkeypatch, name):
    both(monkeypatch, lambda: rows(retrieval.scorers()[name](corpus(frames, base_rate=0.05))))


def test_registered_queries(spark, tmp_path, frames, monkeypatch):
    docs, queries, _ = frames
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    queries.select(F.col("query_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.where("embedding is not null").select(F.col("doc_id").alias("vec_id"), "embedding", (F.col("doc_id") % 3).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    both(monkeypatch, lambda: rows(retrieval.queries()["bayesian_base_rate"](spark, str(tmp_path))))
    both(monkeypatch, lambda: [tuple(pytest.approx(x, abs=1e-6) for x in r[2:]) for r in retrieval.queries()["metrics_by_scorer"](spark, str(tmp_path)).orderBy("scorer").collect()])


def test_features_of_extents(frames):
    """The number of positive scores and the largest, in one row a query."""
    c = corpus(frames)
    given = lambda sparse, extents: sorted(map(tuple, query_features(c.vectors, c.queries, sparse, c.nearest(10), c.signals(), 92, 12, extents).collect()))
    np.testing.assert_allclose(given(None, c.packed().extents()), given(c.sparse(), None), rtol=0, atol=1e-12)
