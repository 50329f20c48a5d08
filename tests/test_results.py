"""Run files judged in bulk, and metric rows out of the payload shapes."""

import json
import math

import pytest

from rankweave.sources.files import write_trec
from rankweave.sources.results import judge_runs, metric_rows, read_metric_rows, read_runs


def plain(run, rel, k):
    """ndcg, map, recall at k of {query: {doc: score}} by {query: {doc: relevance}}, averaged over queries with both."""
    out = []
    for q in run.keys() & rel.keys():
        top = sorted(sorted(run[q], reverse=True), key=lambda d: -run[q][d])[:k]
        gains = [rel[q].get(d, 0) for d in top]
        best = sorted((r for r in rel[q].values() if r > 0), reverse=True)
        dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g))
        hits = [i for i, g in enumerate(gains) if g > 0]
        ap = sum((n + 1) / (i + 1) for n, i in enumerate(hits)) / len(best) if best else 0.0
        out.append((dcg(gains) / dcg(best[:k]) if best else 0.0, ap, len(hits) / len(best) if best else 0.0))
    return [sum(x) / len(out) for x in zip(*out, strict=True)]


def test_judge_runs(spark, tmp_path):
    runs = {
        ("one", "bm25"): {"q1": {"a": 3.0, "b": 2.0, "c": 2.0, "d": 0.5}, "q2": {"x": 1.0, "a": 0.9}, "q9": {"a": 1.0}},
        ("one", "dense"): {"q1": {"d": 0.9, "c": 0.8}, "q2": {"y": 1.0}},
        ("two", "bm25"): {"q1": {"a": 1.0, "b": 5.0}},
    }
    rels = {"one": {"q1": {"a": 2, "c": 1, "z": 3, "b": 0}, "q2": {"a": 1}, "q3": {"a": 1}}, "two": {"q1": {"a": 1, "b": 0}}}
    for (d, s), run in runs.items():
        (tmp_path / "runs" / d).mkdir(parents=True, exist_ok=True)
        lines = [f"{q} Q0 {doc} 7 {score} tag" for q, docs in run.items() for doc, score in docs.items()]
        (tmp_path / "runs" / d / f"{s}.run").write_text("q1 Q0 a 1 99.0 tag\n\n" * (d == "two") + "\n".join(lines) + "\n")
    for d, rel in rels.items():
        (tmp_path / f"{d}.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{q}\t{doc}\t{r}\n" for q, docs in rel.items() for doc, r in docs.items()))
    got = {(r.scorer, r.dataset, r.cutoff): r for r in judge_runs(spark, str(tmp_path / "runs"), {d: str(tmp_path / f"{d}.tsv") for d in rels}, [1, 3]).collect()}
    for k in (1, 3):
        own = {(s, d): plain(run, rels[d], k) for (d, s), run in runs.items()}
        for (s, d), want in own.items():
            assert [got[s, d, k][m] for m in ("ndcg", "map", "recall")] == pytest.approx(want)
        both = [sum(x) / 2 for x in zip(own["bm25", "one"], own["bm25", "two"], strict=True)]
        assert [got["bm25", None, k][m] for m in ("ndcg", "map", "recall")] == pytest.approx(both)
        assert (got["bm25", None, k].datasets, got["bm25", None, k].queries, got["dense", None, k].datasets) == (2, 3, 1)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.run").write_text("q1 Q0 a 1 0.5\n")
    with pytest.raises(Exception, match="no run line"):
        read_runs(spark, str(tmp_path / "bad")).collect()


def test_written_runs_are_read(spark, tmp_path):
    rows = [("bm25", "q", "a", 1.5), ("bm25", "q", "b", 0.5), ("rrf", "p", "a", 0.25)]
    write_trec(spark.createDataFrame(rows, "scorer string, query_id string, doc_id string, score double"), str(tmp_path / "set1"))
    got = read_runs(spark, str(tmp_path)).select("scorer", "query_id", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


PAYLOADS = {
    "lists": {"results": [{"scorer": "bm25", "metrics": {"ndcg@10": 0.5, "map@10": 1}}], "calibration": [{"scorer": "bayesian", "ece": 0.1, "brier": 0.2, "samples": 7}], "average": [{"scorer": "rrf", "metrics": {"ndcg@10": 41.5}}, {"scorer": "bm25", "metrics": {"ndcg@10": 0.6}}]},
    "runs": {"runs": [{"dataset": "fiqa", "results": [{"scorer": "bm25", "metrics": {"ndcg@10": 0.2, "note": "x"}}], "calibration": [{"scorer": "cal", "ece": 0.3}]}, {"results": [{"scorer": "dense", "metrics": {"map": 2}}]}], "config": {"k": {"a": 1}}},
    "plain": {"fiqa": {"bm25": {"ndcg": 0.1}, "skip": 3}, "scidocs": {"bm25": {"ndcg": 0.4}}, "seed": 42},
    "nested": {"results": {"fiqa": {"bm25": {"ndcg": 0.7, "ok": None}}}, "other": {"x": {"y": {"z": 1}}}},
}
EXPECTED = {
    ("lists", "average", "bm25", "ndcg@10", 0.6), ("lists", "average", "bayesian", "ece", 0.1), ("lists", "average", "bayesian", "brier", 0.2), ("lists", "average", "bayesian", "samples", 7.0), ("lists", "average", "rrf", "ndcg@10", 41.5),
    ("runs", "fiqa", "bm25", "ndcg@10", 0.2), ("runs", "fiqa", "cal", "ece", 0.3), ("runs", "dataset", "dense", "map", 2.0),
    ("plain", "fiqa", "bm25", "ndcg", 0.1), ("plain", "scidocs", "bm25", "ndcg", 0.4), ("nested", "fiqa", "bm25", "ndcg", 0.7),
}


def test_metric_rows(spark, tmp_path):
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in PAYLOADS.items()], "file string, value string")
    assert {tuple(r) for r in metric_rows(frame).collect()} == EXPECTED
    (tmp_path / "a.json").write_text(json.dumps(PAYLOADS["plain"], indent=1))
    assert {tuple(r)[1:] for r in read_metric_rows(spark, str(tmp_path)).collect()} == {r[1:] for r in EXPECTED if r[0] == "plain"}
