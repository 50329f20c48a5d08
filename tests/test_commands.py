import json

import pytest
from pyspark.sql import functions as F

from rankweave import cli
from rankweave.functions.stemming import TOKENIZERS, stem
from rankweave.operators import gates, metrics
from rankweave.operators.learners import AttentionWeights, LearnableWeights, MultiHead, Transform
from rankweave.operators.selfcheck import SelfCheck
from rankweave.operators.training import drawn, explicit_split, numpy_split, protocol, query_features, trainable
from rankweave.plans.retrieval import Corpus
from rankweave.sources import embed, prepare, report
from rankweave.sources.files import read_docs, read_qrels, read_queries
from rankweave.streaming.online import OnlineAttention, OnlineWeights


def test_stems():
    words = {"generously": "generous", "running": "run", "hopping": "hop", "hoping": "hope", "ponies": "poni", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "consistency": "consist", "relational": "relat", "nationality": "nation", "sky": "sky", "happy": "happi", "by": "by", "say": "say", "knack": "knack", "knightly": "knight", "controlling": "control", "agreed": "agre", "proceed": "proceed", "adjustment": "adjust", "communication": "communic"}
    assert {w: stem(w) for w in words} == words


def test_tokenizers(spark):
    row = spark.createDataFrame([("The Running  of ponies",)], "t string").select(*(f(F.col("t")).alias(n) for n, f in TOKENIZERS.items())).first()
    assert row.snowball == ["run", "poni"] and row.split == ["the", "running", "of", "ponies"]


@pytest.fixture
def files(spark, tmp_path):
    docs, queries, qrels = prepare.sample(spark)
    prepare.write_collection(docs, queries, qrels, str(tmp_path))
    return tmp_path


def test_collections_round_trip(spark, files):
    assert read_docs(spark, f"{files}/docs.jsonl").count() == 24 and read_queries(spark, f"{files}/queries.jsonl").count() == 8
    assert read_qrels(spark, f"{files}/qrels.tsv").agg(F.sum("relevance")).first()[0] == 48.0


def test_prepared_records(spark):
    rows = spark.createDataFrame([(1, "A title", None, "the bodies"), (2, None, "", None)], "doc_id long, title string, text string, body string")
    got = {r.doc_id: r for r in prepare.prepare_docs(rows, tokenizer="snowball").collect()}
    assert got["1"].text == "A title the bodies" and got["1"].field_terms == {"title": ["titl"], "body": ["bodi"]} and got["2"].terms == []
    qa = spark.createDataFrame([("b", "second", "x"), ("a", "first", "x"), ("c", "third", "y")], "question_id string, question string, context string")
    docs, queries, qrels = prepare.from_questions(qa)
    assert docs.count() == 2 and {r.query_id for r in queries.collect()} == {"a", "c"}
    assert prepare.prepare_qrels(qrels, docs.limit(0), queries).count() == 0


def test_embedder(spark):
    got = embed.with_embeddings(spark.createDataFrame([(1, "vector search"), (2, None)], "doc_id long, text string"), lambda: embed.hashing_embedder(64)).orderBy("doc_id").collect()
    assert sum(x * x for x in got[0].embedding) == pytest.approx(1.0, rel=1e-6) and set(got[1].embedding) == {0.0}
    assert embed.unit_length(spark.createDataFrame([([3.0, 4.0],)], "embedding array<double>")).first().embedding == [0.6, 0.8]


def test_command_line(spark, files, capsys):
    assert cli.main(["index", f"{files}/docs.jsonl", "-o", f"{files}/index", "--embed", "--bm25-method", "lucene"], spark) == 0
    capsys.readouterr()
    for mode in cli.MODES:
        assert cli.main(["search", "vector search", "--index", f"{files}/index", "--mode", mode, "--top-k", "3", "--embed"], spark) == 0
        lines = capsys.readouterr().out.splitlines()
        assert len(lines) == 3 and lines[0].split("\t")[1].startswith("d1")
    assert cli.main(["search", "x", "--index", f"{files}/index", "--mode", "or"], spark) == 1
    bench = ["bench", "--docs", f"{files}/docs.jsonl", "--queries", f"{files}/queries.jsonl", "--qrels", f"{files}/qrels.tsv", "--cutoffs", "3", "--bm25-method", "lucene", "--calibration"]
    assert cli.main([*bench, "--scorers", "BM25, rrf,bayesian,bayesian-no-base-rate,bayesian-attention_split", "--base-rate", "auto", "--alpha", "auto", "--json", "--trec-run-dir", f"{files}/runs"], spark) == 0
    got = json.loads(capsys.readouterr().out.splitlines()[-1])
    by = {r["scorer"]: r for r in got["results"]}
    assert by["rrf"]["recall"] == 1.0 and by["bm25"]["queries"] == 8 and by["bayesian_attention_split"]["queries"] == 4 and got["parameters"]["base_rate"] > 0
    assert {r["scorer"] for r in got["calibration"]} >= {"bayesian", "bayesian_attention_split"} and by["bayesian_no_base_rate"]["queries"] == 8
    (files / "split.json").write_text(json.dumps({"train": [f"q{i}" for i in range(6)], "eval": ["q6", "q7"]}))
    assert cli.main([*bench, "--scorers", "bayesian_fitted_split", "--metric-style", "python-reference", "--fit-split-file", f"{files}/split.json"], spark) == 0
    assert "bayesian_fitted_split\t2" in capsys.readouterr().out
    assert cli.main([*bench, "--scorers", "nothing"], spark) == 1


def test_splits():
    ids = list("abcdefg")
    train, rest = protocol(ids, "cv")
    assert sorted(q for q, _ in rest) == ids and {m for m, _, _ in train} == set(range(5))
    model = dict(rest)
    assert all(model[q] != m for m, q, _ in train)
    assert protocol(["a"], "cv") == ([], []) and len(protocol(ids, "all")[1]) == 7
    assert explicit_split(ids, ["a"], ["b"]) == (["a"], ["b"])
    for bad in ((["a"], None), (["a"], ["a"]), (["z"], ["a"])):
        with pytest.raises(ValueError):
            explicit_split(ids, *bad)
    a, b = numpy_split(ids, 0.5, 42)
    assert len(a) == 3 and sorted(a + b) == ids
    assert trainable([1] * 5 + [0] * 5) and not trainable([1] * 10) and not trainable([1, 0])


def test_drawn_negatives(spark):
    rows = spark.createDataFrame([(1, i, 1.0 if i < 3 else 0.0 if i == 3 else None) for i in range(20)], "query_id long, doc_id long, relevance double")
    order = spark.createDataFrame([(0, 1, 43), (1, 1, 44)], "model int, query_id long, seed long")
    got = drawn(rows, order).collect()
    for m in (0, 1):
        mine = [r for r in got if r.model == m]
        assert len(mine) == 7 and sum(r.label for r in mine) == 3.0 and len({r.doc_id for r in mine}) == 7


def test_query_features(spark):
    docs, queries, qrels = prepare.sample(spark)
    c = Corpus(docs, queries, qrels)
    sig = c.signals()
    got = {r.query_id: r for r in query_features(c.vectors, c.queries, c.sparse(), c.dense(), sig, 24).collect()}
    assert len(got) == 8 and got["q0"].f0 == pytest.approx(1.0986122886681098) and 0 < got["q0"].f1 <= 1 and got["q0"].f6 == 1.0
    cos = sorted((r.cos for r in c.dense().where("query_id = 'q0'").collect()), reverse=True)[:10]
    assert got["q0"].f3 == pytest.approx(sum(cos) / 10)


def test_self_checks(spark):
    docs, queries, qrels = prepare.sample(spark)
    c = Corpus(docs, queries, qrels)
    got = SelfCheck(c.index, queries, c.signals(), c.qrels).run_all().collect()
    assert [r.number for r in got] == list(range(1, 14)) and all(r.passed for r in got), got


def test_runs_of_several_scorers(spark):
    qrels = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 0.0), ("q2", "a", 1.0)], "query_id string, doc_id string, relevance double")
    runs = spark.createDataFrame([("bayesian", "q1", "a", 0.9), ("bayesian", "q1", "b", 0.8), ("bayesian", "q1", "c", 0.7), ("bm25", "q2", "c", 5.0), ("bm25", "q2", "a", 4.0)], "scorer string, query_id string, doc_id string, score double")
    by = {r.scorer: r for r in metrics.evaluate(runs, qrels, [2]).collect()}
    assert by["bayesian"].mrr == 1.0 and by["bm25"].mrr == 0.5 and by["bm25"].queries == 1
    judged = metrics.evaluate_calibration(runs, qrels, 10).collect()
    assert [(r.scorer, r.samples) for r in judged] == [("bayesian", 2)]
    assert judged[0].brier == pytest.approx((0.01 + 0.64) / 2)
    assert metrics.evaluate_calibration(runs, qrels, 10, "python-reference").first().samples == 3
    sets = metrics.evaluate(runs, qrels, [2]).withColumn("dataset", F.lit("x"))
    assert metrics.over_datasets(sets.union(sets.withColumn("dataset", F.lit("y")))).where("dataset is null and scorer = 'bm25'").first().queries == 2
    assert report.metric_table(metrics.evaluate(runs, qrels, [2])).splitlines()[1].startswith("bayesian\t1\t1.0000")
    pairs = spark.createDataFrame([(0.2, 0.0), (0.9, 1.0)], "p double, y double")
    assert "samples            2" in report.calibration_report(metrics.calibration(pairs), metrics.reliability(pairs))


def rows(spark, values):
    return spark.createDataFrame([("d", m, k, v, kind) for m, k, v, kind in values], "dataset string, method string, metric string, value double, kind string")


def test_gates(spark):
    ran = rows(spark, [("bm25", "ndcg@10", 0.35, "zero-shot"), ("rrf", "NDCG@10", 40.0, "zero-shot"), ("fused", "ndcg_cut_10", 41.0, "zero-shot"), ("tuned", "ndcg10", 45.0, "tuned"), ("base", "ece", 0.6, "x"), ("bayesian", "ece", 0.2, "x"), ("fit", "ece", 0.03, "x")])
    old = rows(spark, [("BM25", "ndcg@10", 35.2, ""), ("fused", "ndcg@10", 41.4, "")])
    got = {r.method: r for r in gates.parity(old, ran, ["bm25", "fused", "other"]).collect()}
    assert got["bm25"].passed and got["fused"].passed and not got["other"].passed and got["other"].classification == "evaluator"
    assert not gates.passed(gates.parity(old, ran, ["bm25"], within=0.1)) and gates.passed(gates.parity(old, ran, ["bm25"], by_dataset=True), 2)
    assert gates.passed(gates.ordering(ran, ["fused", "rrf", "bm25"])) and not gates.passed(gates.ordering(ran, ["bm25", "rrf"]))
    cal = {r.check: r for r in gates.calibration_gate(ran, baseline="base", fitted="fit").collect()}
    assert cal["reduction"].passed and cal["reduction"].value == pytest.approx(2 / 3) and not cal["fitted_threshold"].passed
    assert not gates.passed(gates.calibration_gate(ran, ["absent"], fitted=None))
    claims = gates.hybrid_gate(ran, old, ["fused", "tuned"]).collect()
    assert [(r.method, r.passed) for r in claims] == [("fused", True)]
    assert dict(gates.same_protocol({"datasets": ["a"], "evaluator": "e", "metric": "ndcg@10"}, {"datasets": ["a"], "evaluator": "e", "metric": "NDCG_cut_10"})) == {"same_inputs": True, "same_evaluator": True, "same_metric": True}
    assert gates.metric_name("ndcg_cut10") == "ndcg@10" and gates.scale("ece") == "unit"


def test_weights_learn_from_a_stream(spark, tmp_path):
    data = spark.createDataFrame([(i, [0.9, 0.2 + 0.1 * (i % 3)], [1.0], float(i % 2)) for i in range(6)], "event_time long, probs array<double>, features array<double>, label double")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = {"weights": OnlineWeights(LearnableWeights(2)), "one": OnlineAttention(AttentionWeights(2, 1)), "heads": OnlineAttention(MultiHead(2, 1, 2))}
    for name, o in made.items():
        o.start(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), str(tmp_path / name), availableNow=True).awaitTermination(60)
        assert o.state()["updates"] == 6
    want = AttentionWeights(2, 1)
    for r in data.orderBy("event_time").collect():
        want.update([r.probs], [r.label], r.features)
    assert made["one"].state()["theta"][0] == pytest.approx(want.state.theta.tolist())


def test_heads_prune():
    m = MultiHead(2, 1, 3)
    bounds = [[0.95, 0.9], [0.2, 0.1]]
    rows_, fused = m.prune([[0.9, 0.8], [0.1, 0.1]], [1, 2], bounds, 0.5)
    assert rows_.tolist() == [0] and fused[0] == pytest.approx(float(m.combine([[0.9, 0.8]], [1])[0]))
    assert (m.upper_bounds(bounds, [1, 2]) >= m.combine([[0.9, 0.8], [0.1, 0.1]], [1, 2])).all()


def test_prior_of_the_callers_own(spark):
    t = Transform(1.0, 0.5)
    row = spark.range(1).select(t.column(F.lit(2.0), F.lit(1.0), F.lit(1.0), prior_free=True).alias("free"), t.column(F.lit(2.0), F.lit(1.0), F.lit(1.0), lambda s, tf, r: F.lit(0.5)).alias("own")).first()
    assert row.free == row.own == pytest.approx(0.8175744761936437)
