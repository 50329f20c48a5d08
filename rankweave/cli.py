"""Command line: index, search, warmup and bench over JSON-lines collections.

python -m rankweave.cli bench --docs docs.jsonl --queries queries.jsonl --qrels qrels.tsv --scorers bm25,rrf
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .functions.analysis import scorer_name
from .operators import base_rate, metrics, scoring, training
from .operators.dense import cosines
from .operators.index import Index, Params
from .plans import learning, retrieval
from .plans.retrieval import Corpus, Options
from .sources import report
from .sources.embed import hashing_embedder, with_embeddings
from .sources.files import read_docs, read_qrels, read_queries, write_trec

STYLES, METHODS, MODES, RATES = ("pytrec", "python-reference"), ("robertson", "lucene"), ("bm25", "bayesian", "or", "and"), ("percentile", "mixture", "elbow")


def _rate(text: str) -> float | str | None:
    if text in ("none", "auto"):
        return None if text == "none" else text
    value = float(text)
    if not 0 < value < 1:
        raise argparse.ArgumentTypeError("the base rate must be none, auto or lie in (0, 1)")
    return value


def _number(text: str) -> float | str:
    return text if text == "auto" else float(text)


def _count(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("must be a positive whole number")
    return int(text)


def _names(text: str) -> list[str]:
    return [scorer_name(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankweave")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **args) -> argparse.ArgumentParser:
        s = sub.add_parser(name, **args)
        s.add_argument("--embed", action="store_true", help="make vectors with the hashing embedder")
        s.add_argument("--dims", type=_count, default=64)
        return s

    i = add("index", help="build and store an index")
    i.add_argument("docs")
    i.add_argument("-o", "--out", required=True)
    for name, default in (("--id-field", "doc_id"), ("--text-field", "text"), ("--terms-field", "terms"), ("--embedding-field", "embedding")):
        i.add_argument(name, default=default)
    i.add_argument("--metric-style", choices=STYLES, default="pytrec")
    s = add("search", help="the best documents for a query")
    s.add_argument("query")
    s.add_argument("--index", required=True)
    s.add_argument("--top-k", type=_count, default=10)
    s.add_argument("--mode", choices=MODES, default="bm25")
    add("warmup", help="load the embedder once")
    b = add("bench", help="rank, judge and calibrate scorers")
    for name in ("--docs", "--queries", "--qrels"):
        b.add_argument(name, required=True)
    b.add_argument("--cutoffs", type=lambda t: sorted(int(x) for x in t.split(",") if int(x) > 0), default=[5, 10, 20, 100])
    b.add_argument("--scorers", type=_names, help="separated by commas; all without it")
    b.add_argument("--metric-style", choices=STYLES, default="pytrec")
    b.add_argument("--alpha", type=_number, default=1.0)
    b.add_argument("--beta", type=_number, default=0.5)
    b.add_argument("--base-rate", type=_rate)
    b.add_argument("--base-rate-method", choices=RATES, default="percentile")
    b.add_argument("--base-rate-sample-size", type=_count, default=50)
    b.add_argument("--base-rate-seed", type=int, default=42)
    b.add_argument("--candidate-depth", type=_count, default=100)
    b.add_argument("--fit-train-ratio", type=float, default=0.5)
    b.add_argument("--fit-split-seed", type=int, default=42)
    b.add_argument("--fit-split-file")
    for name, default in (("--doc-terms", "terms"), ("--query-terms", "terms"), ("--doc-embedding", "embedding"), ("--query-embedding", "embedding")):
        b.add_argument(name, default=default)
    b.add_argument("--trec-run-dir")
    b.add_argument("--trec-run-depth", type=_count, default=1000)
    b.add_argument("--calibration", action="store_true")
    b.add_argument("--calibration-bins", type=_count, default=10)
    b.add_argument("--json", action="store_true")
    b.add_argument("--output-json")
    for x in (i, b):
        x.add_argument("--k1", type=float, default=1.2)
        x.add_argument("--b", type=float, default=0.75)
        x.add_argument("--bm25-method", choices=METHODS, default="robertson")
    return p


def _index(spark: SparkSession, a: argparse.Namespace) -> str:
    docs = read_docs(spark, a.docs, doc_id=a.id_field, text=a.text_field, terms=a.terms_field, embedding=a.embedding_field)
    if a.embed:
        docs = with_embeddings(docs, lambda: hashing_embedder(a.dims))
    index = Index.build(docs, terms="terms", params=Params(k1=a.k1, b=a.b, method=a.bm25_method))
    index.save(a.out)
    docs.select("doc_id", "embedding").write.mode("overwrite").parquet(f"{a.out}/vectors")
    row = index.corpus_stats().first()
    return f"{int(row.n)} documents, {row.avgdl:.2f} terms each\n"


def _search(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.mode in ("or", "and") and not a.embed:
        raise ValueError(f"search --mode {a.mode} needs a query vector; pass --embed")
    index = Index.load(spark, a.index)
    query = spark.createDataFrame([("q", a.query)], "query_id string, text string")
    found = scoring.sparse_scores(index, scoring.query_terms(query))
    if a.mode in ("bm25", "bayesian"):
        score = "bm25" if a.mode == "bm25" else "bayes"
        return report.search_lines(scoring.zero_filled_top(found.select("query_id", "doc_id", F.col(score).alias("score")), query, index.docs, a.top_k))
    vector = with_embeddings(query, lambda: hashing_embedder(a.dims)).select("query_id", "embedding")
    dense = cosines(spark.read.parquet(f"{a.index}/vectors"), vector)
    both = dense.join(found.select("query_id", "doc_id", "bayes"), ["query_id", "doc_id"], "left").na.fill(0.0, ["bayes"])
    v = X.vector_probability(F.col("cos"))
    if a.mode == "or":
        score = X.prob_or([F.col("bayes"), v])
    else:
        score = F.when((F.col("bayes") < X.EPSILON) & (v < X.EPSILON), 0.0).otherwise(X.log_odds_conjunction([F.col("bayes"), v], index.params.hybrid_alpha))
    return report.search_lines(scoring.top_k(both.withColumn("score", score), a.top_k))


def _resolved(index: Index, a: argparse.Namespace) -> tuple[Params, float | None]:
    """Parameters with what ``auto`` stands for, from pseudo-queries of drawn documents."""
    p = index.params
    if "auto" not in (a.alpha, a.beta, a.base_rate):
        return Params(p.k1, p.b, p.method, a.alpha, a.beta, a.base_rate), a.base_rate
    n = index.docs.count()
    ids = training.drawn_documents(index.docs, n, a.base_rate_sample_size, a.base_rate_seed)
    scores = base_rate.pseudo_scores(index, ids).persist()
    auto = base_rate.auto_parameters(scores).first()
    rate = a.base_rate
    if rate == "auto" and a.base_rate_method == "percentile":
        rate = base_rate.percentile_rate(scores, n).first().base_rate
    elif rate == "auto" and a.base_rate_method == "elbow":
        rate = base_rate.elbow_rate(scores).first().base_rate
    elif rate == "auto":
        rate = base_rate.mixture_rate(scores).first().base_rate
    alpha, beta = auto.alpha if a.alpha == "auto" else a.alpha, auto.beta if a.beta == "auto" else a.beta
    return Params(p.k1, p.b, p.method, alpha, beta, rate), rate


def _bench(spark: SparkSession, a: argparse.Namespace) -> str:
    docs = read_docs(spark, a.docs, terms=a.doc_terms, embedding=a.doc_embedding)
    queries, qrels = read_queries(spark, a.queries, terms=a.query_terms, embedding=a.query_embedding), read_qrels(spark, a.qrels)
    if a.embed:
        docs, queries = (with_embeddings(x, lambda: hashing_embedder(a.dims)) for x in (docs, queries))
    judged = queries.join(qrels.select("query_id"), "query_id", "left_semi")
    params, rate = _resolved(Index.build(docs, terms="terms", params=Params(k1=a.k1, b=a.b, method=a.bm25_method)), a)
    split = None
    if a.fit_split_file:
        split = training.explicit_split([r.query_id for r in judged.select("query_id").collect()], *report.read_split(a.fit_split_file))
    options = Options(top=max([*a.cutoffs, a.trec_run_depth if a.trec_run_dir else 0]), depth=a.candidate_depth, base_rate=rate, ratio=a.fit_train_ratio, seed=a.fit_split_seed, split=split, style=a.metric_style)
    corpus = Corpus(docs, judged, qrels, params, options)
    known = retrieval.scorers() | learning.scorers()
    names = a.scorers or list(known)
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown scorers: {', '.join(unknown)}")
    runs = reduce(DataFrame.unionByName, [known[n](corpus).select(F.lit(n).alias("scorer"), "query_id", "doc_id", "score") for n in names]).persist()
    results = metrics.evaluate(runs, qrels, a.cutoffs, a.metric_style)
    if a.trec_run_dir:
        write_trec(runs, a.trec_run_dir, a.trec_run_depth)
    calibrated = metrics.evaluate_calibration(runs, qrels, a.calibration_bins, a.metric_style) if a.calibration else None
    tables = {"results": results, "parameters": {"alpha": params.alpha, "beta": params.beta, "base_rate": rate}} | ({"calibration": calibrated} if calibrated is not None else {})
    if a.output_json:
        with open(a.output_json, "w", encoding="utf-8") as f:
            f.write(report.payload(**tables) + "\n")
    if a.json:
        return report.payload(**tables) + "\n"
    return report.metric_table(results) + (report.calibration_table(calibrated) if calibrated is not None else "")


def _warmup(_: SparkSession, a: argparse.Namespace) -> str:
    return f"{hashing_embedder(a.dims)(['ready']).shape[1]} dimensions\n"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rankweave").getOrCreate()
    try:
        sys.stdout.write({"index": _index, "search": _search, "warmup": _warmup, "bench": _bench}[a.command](spark, a))
    except ValueError as e:
        sys.stderr.write(f"{e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
