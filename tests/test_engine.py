import math

import pytest
from pyspark.sql import functions as F

from rankweave.functions import exprs as X
from rankweave.functions.analysis import tokenize
from rankweave.operators import explain, metrics, scoring
from rankweave.operators.index import Index, Params, block_max
from rankweave.sources.files import read_docs, read_qrels, read_queries, read_trec, write_trec

near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-12)


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_tokens(spark):
    cases = {"café": ["caf"], "한글 text": ["text"], "TF-IDF": ["tf", "idf"], "": [], "Kelvin": ["elvin"], None: []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tokenize(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_probabilities(spark):
    lit = lambda x: F.lit(float(x))
    for x, want in {-1: 0.18242552380635632, 0.5: 0.5, 5: 0.9890130573694068}.items():
        assert value(spark, X.likelihood(lit(x))) == near(want)
    for (a, p, br), want in {(0.8, 0.6, None): 0.8571428571428572, (0.9, 0.5, 0.01): 0.08333333333333336, (0.99, 0.2, 0.3): 0.9138461538461539}.items():
        assert value(spark, X.posterior(lit(a), lit(p), br)) == near(want)
    for (s, tf, r), want in {(1, 5, 0.5): 0.7578798583144893, (2, 1, 1.2): 0.6342684387121702, (0.5, 0, 0.1): 0.266, (3, 10, 0.8): 0.978897249852682}.items():
        assert value(spark, X.score_to_probability(lit(s), lit(tf), lit(r), 1.0, 0.5)) == near(want)
    assert value(spark, X.wand_upper_bound(lit(2), 1.0, 0.5)) == near(0.9758075451312032)
    assert value(spark, X.log_odds_conjunction([lit(0.8), lit(0.6)])) == near(0.7802228097654433)
    assert value(spark, X.log_odds_conjunction([lit(0.8), lit(0.6)], 0.0, [0.3, 0.7])) == near(0.6681243335179892)
    assert value(spark, X.prob_and([lit(0.8), lit(0.6)])) == near(0.48) and value(spark, X.prob_or([lit(0.8), lit(0.6)])) == near(0.92)
    assert value(spark, X.log_odds_conjunction([])) == 0.5
    with pytest.raises(ValueError):
        X.log_odds_conjunction([lit(0.5)], weights=[0.4])
    for x in (-1000.0, 0.0, 1000.0):
        assert 0 <= value(spark, X.sigmoid(lit(x))) <= 1


def test_traces(spark):
    t = value(spark, explain.trace_bm25(F.lit(2.0), F.lit(5.0), F.lit(0.6)))
    assert (t.posterior, t.prior, t.logit_prior) == (near(0.8792456383574068), near(0.619), near(0.48530589755789505))
    assert value(spark, explain.trace_vector(F.lit(0.6))).probability == near(0.8)
    with pytest.raises(ValueError):
        explain.trace_fusion(["a"], [F.lit(0.5)], "other")


def test_bm25_against_plain_python(spark):
    docs = [(1, "a b b c"), (2, "a a d"), (3, "c c c"), (4, None), (5, "")]
    for method in ("robertson", "lucene"):
        index = Index.build(spark.createDataFrame(docs, "doc_id long, text string"), params=Params(method=method))
        q = scoring.query_terms(spark.createDataFrame([(9, "a b a z")], "query_id long, text string"))
        got = {r.doc_id: r.bm25 for r in scoring.sparse_scores(index, q).collect()}
        toks = {i: (t or "").split() for i, t in docs}
        avg = sum(map(len, toks.values())) / 5
        want = {}
        for i, t in toks.items():
            for term, n in (("a", 2), ("b", 1)):
                tf, df = t.count(term), sum(term in x for x in toks.values())
                if tf:
                    odds = (5 - df + 0.5) / (df + 0.5)
                    w = math.log(1 + odds) if method == "lucene" else math.log(odds)
                    want[i] = want.get(i, 0) + n * w * tf / (1.2 * (0.25 + 0.75 * len(t) / avg) + tf) * (1 if method == "lucene" else 2.2)
        assert got == {k: near(v) for k, v in want.items()}


def test_documents_without_a_match_score_zero(spark):
    docs = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    matched = spark.createDataFrame([(1, 3, 0.5), (1, 4, -0.5)], "query_id long, doc_id long, score double")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in scoring.zero_filled_top(matched, q, docs, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 3, 1), (1, 0, 2), (1, 1, 3), (2, 0, 1), (2, 1, 2), (2, 2, 3)]


def test_ranking_metrics(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1.0), ("q1", "d2", 0.0), ("q1", "d3", 1.0), ("q2", "d4", 1.0)], "query_id string, doc_id string, relevance double")
    ranked = spark.createDataFrame([("q1", "d2", 1), ("q1", "d1", 2), ("q1", "d3", 3), ("q2", "d5", 1), ("q2", "d4", 2), ("q2", "d6", 3)], "query_id string, doc_id string, rank int")
    by = {r.query_id: r for r in metrics.ranking_metrics(ranked, qrels, [3]).collect()}
    assert (by["q1"].ndcg, by["q1"].map, by["q1"].mrr, by["q1"].recall) == (near(0.6934264036172708), near(0.5833333333333333), 0.5, 1.0)
    assert (by["q2"].ndcg, by["q2"].map) == (near(0.6309297535714575), 0.5)
    mean = metrics.mean_metrics(metrics.ranking_metrics(ranked, qrels, [3])).first()
    assert (mean.ndcg, mean.map) == (near(0.6621780785943642), near(0.5416666666666667))


def test_calibration(spark):
    pairs = spark.createDataFrame([(0.1, 0.0), (0.4, 0.0), (0.6, 1.0), (0.9, 1.0), (1.5, 1.0)], "p double, y double")
    r = metrics.calibration(pairs, 2).first()
    assert r.samples == 5 and r.ece == near((2 * 0.25 + 2 * 0.25) / 5)
    assert metrics.calibration(pairs.limit(0)).first().ece == 0.0


def test_block_max(spark):
    rows = [("t", i, v) for i, v in enumerate([1.0, 3.0, 2.0, 5.0, 4.0, 0.5, 2.5])]
    got = block_max(spark.createDataFrame(rows, "term string, doc_ord long, score double"), 3).orderBy("block_id").collect()
    assert [r.max_score for r in got] == [3.0, 5.0, 2.5]


def test_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('# comment\n\n{"doc_id":"a","text":"x","terms":"p  q","embedding":[1,2]}\n{"doc_id":"b","text":"y"}\n')
    d = {r.doc_id: r for r in read_docs(spark, str(tmp_path / "d.jsonl")).collect()}
    assert d["a"].terms == ["p", "q"] and d["b"].embedding == [] and d["b"].terms is None
    (tmp_path / "q.jsonl").write_text('{"query_id":"a","text":"x"}\n')
    assert read_queries(spark, str(tmp_path / "q.jsonl")).first().embedding is None
    (tmp_path / "r.tsv").write_text("query\tdoc\trelevance\nq1\t0\td1\t2\nq1\td2\t1\nq1\td2\t3\nshort\n")
    assert {r.doc_id: r.relevance for r in read_qrels(spark, str(tmp_path / "r.tsv")).collect()} == {"d1": 2.0, "d2": 3.0}
    runs = spark.createDataFrame([("s", "q", "a", 1.0), ("s", "q", "b", 2.0), ("s", "q", "c", float("nan"))], "scorer string, query_id string, doc_id string, score double")
    write_trec(runs, str(tmp_path / "t"))
    got = read_trec(spark, str(tmp_path / "t" / "scorer=s")).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [("b", 1), ("a", 2)]


def test_index_round_trip(spark, tmp_path):
    index = Index.build(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), params=Params(k1=0.9, base_rate=0.1))
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert again.params == index.params and again.docs.count() == 2
    with pytest.raises(ValueError):
        Params(base_rate=1.0)


def test_online_stream(spark, tmp_path):
    from rankweave.streaming.online import OnlineTransform

    rows = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(zip([0.5, 1.5, 2.5, 3.5, 4.5, 0.8, 2.2], [0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0], strict=True))], "event_time long, score double, label double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    o = OnlineTransform(rate=0.05, momentum=0.9, tau=1000, clip=1.0, decay=0.99)
    q = o.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(60)
    assert o.state()["alpha"] == near(0.8889036208928396) and o.state()["updates"] == 7


def test_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
