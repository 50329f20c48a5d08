"""Ranking and calibration metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, cutoffs: list[int], style: str = "pytrec") -> DataFrame:
    """(query_id, cutoff, ndcg, map, mrr, recall) of ranked(query_id, doc_id, rank) for queries with judgments.

    pytrec: exponential gain, the ideal from all judgments, average precision over all
    relevant. python-reference: linear gain, the ideal from what was retrieved, average
    precision over the hits. evaluator: as pytrec with linear gain.
    """
    top = max(cutoffs)
    qrels = qrels.select("query_id", "doc_id", F.col("relevance").cast("double").alias("relevance"))
    judged = qrels.groupBy("query_id").agg(F.sum((F.col("relevance") > 0).cast("int")).alias("relevant"))
    rows = ranked.where(F.col("rank") <= top).join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("relevance", F.lit(0.0)))
    gain = (lambda r: F.pow(F.lit(2.0), r) - 1.0) if style == "pytrec" else (lambda r: r)
    order = Window.partitionBy("query_id").orderBy("rank")
    hit = (F.col("rel") > 0).cast("int")
    rows = rows.select("query_id", "rank", "rel", hit.alias("hit"), F.sum(hit).over(order).alias("hits"))
    disc = lambda r: F.log2(r + 1.0)
    ks = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in cutoffs], "cutoff int"))
    cut = rows.crossJoin(ks).where(F.col("rank") <= F.col("cutoff"))
    got = cut.groupBy("query_id", "cutoff").agg(
        F.sum(F.when(F.col("rel") > 0, gain(F.col("rel")) / disc(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum("hit").alias("found"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("rel"))
    if style != "python-reference":
        ideal = qrels.where("relevance > 0").select("query_id", F.col("relevance").alias("rel")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= top)
        ideal = ideal.crossJoin(ks).where(F.col("r") <= F.col("cutoff"))
    else:
        ideal = cut.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "cutoff").orderBy(F.desc("rel"))))
    ideal = ideal.groupBy("query_id", "cutoff").agg(F.sum(F.when(F.col("rel") > 0, gain(F.col("rel")) / disc(F.col("r"))).otherwise(0.0)).alias("best"))
    base = judged.crossJoin(ks).join(got, ["query_id", "cutoff"], "left").join(ideal, ["query_id", "cutoff"], "left")
    full = F.col("found") if style == "python-reference" else F.col("relevant")
    ratio = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0.0)) / F.when(b > 0, b)).otherwise(0.0)
    return base.select("query_id", "cutoff", ratio(F.col("dcg"), F.col("best")).alias("ndcg"), ratio(F.col("ap"), full).alias("map"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), ratio(F.col("found").cast("double"), F.col("relevant")).alias("recall"))


def mean_metrics(by_query: DataFrame) -> DataFrame:
    return by_query.groupBy("cutoff").agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in ("ndcg", "map", "mrr", "recall")))


def reliability(pairs: DataFrame, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """From (*by, p, y) each non-empty bin (low, high] (the first with its low end): *by, bin, mean_p, mean_y, n.

    Bounds are compared as i / n, never by scaling p, which rounds otherwise at the edges.
    """
    edge = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        inside = (F.col("p") <= (i + 1) / bins) & ((F.col("p") >= 0) if i == 0 else (F.col("p") > i / bins))
        edge = F.when(inside, i).otherwise(edge)
    return pairs.select(*by, edge.alias("bin"), "p", "y").where("bin is not null").groupBy(*by, "bin").agg(F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))


def calibration(pairs: DataFrame, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each ``by``: ece, brier, samples; probabilities outside all bins count among the samples only."""
    ece = reliability(pairs, bins, by).groupBy(*by).agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))), F.lit(0.0)).alias("gap"))
    all_ = pairs.groupBy(*by).agg(F.count("*").alias("samples"), F.coalesce(F.avg(F.pow(F.col("p") - F.col("y"), 2)), F.lit(0.0)).alias("brier"))
    both = all_.join(ece, list(by), "left") if by else all_.crossJoin(ece)
    return both.select(*by, F.when(F.col("samples") > 0, F.coalesce("gap", F.lit(0.0)) / F.col("samples")).otherwise(0.0).alias("ece"), "brier", "samples")


# --- runs of several scorers ------------------------------------------------------------------

# The scorers whose scores are probabilities.
PROBABILITIES = (
    "bayesian", "bayesian_attention", "bayesian_attention_split", "bayesian_attn_norm", "bayesian_attn_norm_cv", "bayesian_attn_norm_split",
    "bayesian_fitted", "bayesian_fitted_split", "bayesian_gated_gelu", "bayesian_gated_relu", "bayesian_gated_softplus", "bayesian_gated_swish",
    "bayesian_gated_swish_b2", "bayesian_logodds", "bayesian_logodds_br", "bayesian_multifield", "bayesian_multihead", "bayesian_multihead_norm",
    "bayesian_multihead_norm_split", "bayesian_multihead_split", "bayesian_no_base_rate", "bayesian_vector_attn_split", "bayesian_vector_balanced",
    "bayesian_vector_softplus", "dense_isotonic_split", "dense_platt_split", "hybrid_and", "hybrid_or",
)


def evaluate(runs: DataFrame, qrels: DataFrame, cutoffs: list[int], style: str = "pytrec") -> DataFrame:
    """runs(scorer, query_id, doc_id, score) to (scorer, cutoff, queries, ndcg, map, mrr, recall).

    A scorer's mean is over the judged queries it ranked.
    """
    key = F.struct("scorer", F.col("query_id").alias("q")).alias("query_id")
    w = Window.partitionBy("scorer", "query_id").orderBy(F.round("score", 9).desc(), F.col("doc_id"))
    ranked = runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(cutoffs)).select(key, "doc_id", "rank")
    seen = runs.select("scorer", "query_id").distinct()
    judged = qrels.join(seen, "query_id").select(key, "doc_id", "relevance")
    by = ranking_metrics(ranked, judged, cutoffs, style).select(F.col("query_id.scorer").alias("scorer"), "cutoff", "ndcg", "map", "mrr", "recall")
    return by.groupBy("scorer", "cutoff").agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in ("ndcg", "map", "mrr", "recall")))


def judged_means(runs: DataFrame, qrels: DataFrame, cutoffs: list[int]) -> DataFrame:
    """runs(dataset, scorer, query_id, doc_id, score) by qrels(dataset, query_id, doc_id, relevance):
    (scorer, dataset, cutoff, datasets, queries, ndcg, map, mrr, recall), as a run file's evaluator has them.

    A query's documents stand by score in single precision, of equal ones the larger id first. A data set's
    means are over the queries that have both a judgment and a run; a null dataset has the mean over a scorer's data sets.
    """
    order = Window.partitionBy("dataset", "scorer", "query_id").orderBy(F.col("score").cast("float").desc(), F.col("doc_id").desc())
    key = F.struct("dataset", "scorer", F.col("query_id").alias("q")).alias("query_id")
    ranked = runs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(cutoffs)).select(key, "doc_id", "rank")
    asked = runs.select("dataset", "scorer", "query_id").distinct()
    judged = qrels.join(asked, ["dataset", "query_id"]).select(key, "doc_id", "relevance")
    names = ("ndcg", "map", "mrr", "recall")
    by = ranking_metrics(ranked, judged, cutoffs, "evaluator").select("query_id.dataset", "query_id.scorer", "cutoff", *names)
    means = by.groupBy("dataset", "scorer", "cutoff").agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in names))
    sets = [[F.col("scorer"), F.col("cutoff"), F.col("dataset")], [F.col("scorer"), F.col("cutoff")]]
    out = means.groupingSets(sets, "scorer", "cutoff", "dataset").agg(F.count("*").alias("datasets"), F.sum("queries").alias("queries"), *(F.avg(m).alias(m) for m in names))
    return out.select("scorer", "dataset", "cutoff", "datasets", "queries", *names)


def evaluate_calibration(runs: DataFrame, qrels: DataFrame, bins: int = 10, style: str = "pytrec", scorers: tuple[str, ...] = PROBABILITIES) -> DataFrame:
    """(scorer, ece, brier, samples). pytrec: judged pairs only; python-reference: every positive score of
    a judged query, unjudged documents as negative. Probabilities are clipped into [0, 1]."""
    known = qrels.select("query_id").distinct()
    rows = runs.where(F.col("scorer").isin(*scorers)).join(known, "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left")
    rows = rows.where("relevance is not null") if style == "pytrec" else rows.where((F.col("score") > 0) & ~F.isnan("score"))
    p = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return calibration(rows.select("scorer", p.alias("p"), (F.coalesce("relevance", F.lit(0.0)) > 0).cast("double").alias("y")), bins, ("scorer",))


def over_datasets(results: DataFrame) -> DataFrame:
    """results(dataset, scorer, cutoff, queries, metrics) with a row over all data sets (a null dataset): means, and queries summed."""
    means = [F.avg(m).alias(m) for m in ("ndcg", "map", "mrr", "recall")]
    return results.unionByName(results.groupBy("scorer", "cutoff").agg(F.sum("queries").alias("queries"), *means).withColumn("dataset", F.lit(None).cast("string")))
