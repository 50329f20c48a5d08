"""Bounds by block, ordered ranking, field checks, point lookups, stored postings, base rates and document traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_stored_index_and_lookup(spark, tmp_path):
    from rankweave.operators import scoring
    from rankweave.operators.index import Index, Params, idf, length_norm, rewritten_term_score, upper_bound

    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c"), (3, "d"), (4, ""), (1, "z")], "doc_id long, text string")
    q = scoring.query_terms(spark.createDataFrame([(1, "b c q"), (2, "d a")], "query_id long, text string"))
    for method in ("robertson", "lucene"):
        built = Index.build(docs.where("text <> 'z'"), params=Params(method=method))
        built.save(str(tmp_path / method))
        again = Index.load(spark, str(tmp_path / method))
        assert again.stored and "explode" not in again.postings()._jdf.queryExecution().optimizedPlan().toString().lower()
        key = lambda i: sorted(map(str, scoring.sparse_scores(i, q).collect()))
        assert key(built) == key(again)
        rows = scoring.term_scores(built, q).crossJoin(built.corpus_stats().select("n")).join(built.term_stats(built.postings()), "term")
        w = idf(F.col("n"), F.col("df"), method)
        got = rows.select("raw", rewritten_term_score(w, F.col("tf"), F.col("ratio"), built.params).alias("same"), upper_bound(w, built.params).alias("bound"), length_norm(F.col("ratio"), built.params).alias("norm")).collect()
        assert got and all(r.raw == pytest.approx(r.same) and r.raw <= r.bound + 1e-12 and r.norm > 0 for r in got)
    index = Index.build(docs)
    assert [r.tokens for r in index.get(1).collect()] == [["z"]] and index.get(9).count() == 0


def test_blocks(spark):
    from rankweave.operators.index import block_bounds, block_max, n_blocks

    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 5, 2.0), ("b", 9, 0.5)], "term string, doc_ord long, score double")
    blocks = block_max(scores, 4)
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "term string, block_id long")
    got = {(r.term, r.block_id): (r.max_score, r.bayes_bound) for r in block_bounds(blocks, asked, 10, 4).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", 0): 3.0, ("a", 1): 2.0, ("a", 2): 0.0, ("b", 0): 0.0}
    like = 1 / (1 + np.exp(-3.0))
    assert got["a", 0][1] == pytest.approx(like * 0.9 / (like * 0.9 + (1 - like) * 0.1))
    assert n_blocks(0, 4) == 0 and n_blocks(10, 4) == 3
    for wrong in (("c", 0), ("a", 3)):
        with pytest.raises(Exception, match="unknown term|no block"):
            block_bounds(blocks, spark.createDataFrame([wrong], "term string, block_id long"), 10, 4).collect()


def test_order_of_equal_scores(spark):
    from rankweave.operators import scoring

    scores = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9), (1, "z", 0.5)], "query_id long, doc_id string, score double")
    places = spark.createDataFrame([("c", 0), ("b", 1), ("a", 2)], "doc_id string, place long")
    assert [r.doc_id for r in scoring.top_k(scores, 4).orderBy("rank").collect()] == ["c", "a", "b", "z"]
    assert [r.doc_id for r in scoring.top_k(scoring.in_order(scores, places), 4, order="place").orderBy("rank").collect()] == ["c", "b", "a", "z"]


def test_many_queries_in_blocks(spark, monkeypatch):
    from rankweave.operators import dense, scoring

    rng = np.random.default_rng(1)
    vec = lambda n, name: spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(n)] + [(n, None)], f"{name} long, embedding array<double>")
    docs, queries = vec(30, "doc_id"), vec(17, "query_id")
    docs = docs.unionByName(spark.createDataFrame([(50, []), (51, [1.0]), (52, [float("nan")] * 4), (53, [0.0] * 4), (54, [1.0, 2.0, 3.0, 4.0, 5.0])], docs.schema)).repartition(4)
    x = {r.doc_id: r.embedding for r in docs.collect()}
    want = []
    for r in queries.where("embedding is not null").collect():
        for i, v in x.items():
            v = v if v and np.isfinite(v).all() else []
            size = np.linalg.norm(r.embedding) * np.linalg.norm(v)
            want.append((r.query_id, i, float(np.dot(r.embedding[: len(v)], v[:4]) / size) if size else 0.0))
    close = lambda rows: [(q, d, round(c, 12)) for q, d, c in sorted(rows)]
    assert close(tuple(r) for r in dense.cosines(docs, queries).collect()) == close(want)
    best = lambda: sorted((r.query_id, r["rank"], r.doc_id) for r in scoring.top_k(dense.best_documents(docs, queries, 6), 6, "cos").collect())
    ranked = [(q, k + 1, d) for q in range(17) for k, (_, d) in enumerate(sorted((-round(c, 9), d) for p, d, c in want if p == q)[:6])]
    assert best() == ranked
    monkeypatch.setattr(dense, "QUERY_BATCH", 5)
    monkeypatch.setattr(dense, "HELD", 1)
    monkeypatch.setattr(dense, "CELLS", 40)
    assert best() == ranked
    far = dense.best_documents(docs, queries, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in far and "NestedLoop" not in far
    assert dense.best_documents(docs, queries.where("embedding is null"), 6).count() == 0


def test_no_product_of_short_queries_and_documents(spark):
    from rankweave.operators import scoring

    matched = spark.createDataFrame([(1, 3, 0.5), (1, 0, -1.0), (1, 1, -2.0), (2, 2, 0.0)], "query_id long, doc_id long, score double")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    docs = spark.range(1000).select(F.col("id").alias("doc_id"))
    got = {}
    for r in scoring.zero_filled_top(matched, queries, docs, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    few = spark.createDataFrame([(1, i, -1.0) for i in range(0, 60) if i != 37], "query_id long, doc_id long, score double").unionByName(matched.where("query_id = 2"))
    far = [(r.query_id, r.doc_id, r.score) for r in scoring.zero_filled_top(few, queries, docs, 4).orderBy("query_id", "rank").collect()]
    assert far[:4] == [(1, 37, 0.0), (1, 60, 0.0), (1, 61, 0.0), (1, 62, 0.0)] and far[4:] == [(q, i, 0.0) for q in (2, 3) for i in range(4)]
    all_ = [(r.query_id, r.doc_id) for r in scoring.zero_filled_top(few, queries, spark.range(30).select(F.col("id").alias("doc_id")), 4).orderBy("query_id", "rank").collect()]
    assert all_ == [(1, 0), (1, 1), (1, 2), (1, 3), *((q, i) for q in (2, 3) for i in range(4))]
    assert got == {1: [(3, 0.5), (2, 0.0), (4, 0.0), (5, 0.0)], 2: [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)], 3: [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]}


def test_fields(spark):
    from rankweave.operators.index import check_fields

    docs = spark.createDataFrame([(1, ["a"], ["b"]), (2, [], ["c"])], "doc_id long, title array<string>, body array<string>")
    assert check_fields(docs, ["title", "body"]) == ["title", "body"]
    assert check_fields(docs.withColumn("title", F.array().cast("array<string>")), ["title", "body"]) == []
    for bad, fields in ((docs, []), (docs, ["title", "title"]), (docs.withColumn("body", F.when(F.col("doc_id") == 1, F.col("body"))), ["title", "body"])):
        with pytest.raises(ValueError):
            check_fields(bad, fields)


def test_base_rates_without_collecting(spark):
    from rankweave.operators.base_rate import elbow, elbow_rate, mixture, mixture_rate

    rng = np.random.default_rng(2)
    for x in (np.round(np.concatenate([rng.normal(1, 0.3, 300), rng.normal(4, 0.5, 60)]), 2), np.array([1.0, 1.0, 1.0, 1.0]), np.array([2.0]), np.zeros(0), np.array([5.0, 1.0, 1.0, 1.0, 0.5])):
        df = spark.createDataFrame([(float(v),) for v in x], "score double").repartition(3)
        assert elbow_rate(df).first().base_rate == pytest.approx(elbow(sorted(x, reverse=True)))
        assert mixture_rate(df).first().base_rate == pytest.approx(mixture(x), rel=1e-6)


def test_document_trace(spark):
    from rankweave.operators.explain import trace_document

    row = spark.createDataFrame([(2.0, 3.0, 0.8, 0.4)], "s double, tf double, r double, c double")
    c = F.col
    both = row.select(trace_document(c("s"), c("tf"), c("r"), c("c"), "prob_or").alias("t")).first().t
    p, v = both.signals.BM25.posterior, both.signals.Vector.probability
    assert both.probability == pytest.approx(1 - (1 - p) * (1 - v)) == both.fusion.fused and [s.name for s in both.fusion.signals] == ["BM25", "Vector"]
    assert row.select(trace_document(cos=c("c")).alias("t")).first().t.signals.Vector.probability == pytest.approx(0.7)
    for wrong in ({}, {"bm25": c("s")}):
        with pytest.raises(ValueError):
            trace_document(**wrong)


def test_online_model_survives_a_restart(spark, tmp_path):
    from rankweave.operators.learners import Transform
    from rankweave.streaming.online import OnlineTransform

    rng = np.random.default_rng(3)
    rows = [(int(t), float(s), float(s + rng.normal() > 1)) for t, s in zip(rng.integers(0, 5, 40), rng.normal(1, 1, 40), strict=True)]
    frames = [spark.createDataFrame(x, "event_time long, score double, label double") for x in (rows[:20], rows[20:])]
    whole = OnlineTransform(Transform())
    for i, f in enumerate(frames):
        whole.batch(f, i)
    store = str(tmp_path / "models")
    first = OnlineTransform(Transform(), store=store)
    first.resume(spark)
    first.batch(frames[0].repartition(3), 0)
    again = OnlineTransform(Transform(), store=store)
    again.resume(spark)
    again.batch(frames[0], 0)  # delivered twice
    again.batch(frames[1].repartition(2), 1)
    assert again.state() == whole.state() and again.state()["updates"] == 40
