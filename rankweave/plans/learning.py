"""Registered queries of fitted scorers: models from judged candidates, then ranking with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import base_rate, scoring, training
from ..operators.binned_probability import vector_probabilities
from ..operators.gradients import fit_attention, fit_learnable, fit_sigmoid_binned
from ..operators.learners import AttentionWeights, Isotonic, MultiHead, Platt, Transform, descend, fit_by_group, isotonic_blocks
from ..operators.packed import Packed
from .retrieval import _SIGNALS, _VECTORS, DEPTH, Corpus, Scorer, _base, _logit, _safe, _sigmoid, shown

#: Bins of scores in a unit of BM25 and of cosine.
SPARSE_BINS, DENSE_BINS = 1 << 10, 1 << 16
PSEUDO_QUERIES = 50


def _judged(c: Corpus) -> DataFrame:
    rows = c.signals().join(c.qrels, ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", "rank_sparse", "rank_dense", "bm25", "bayes", "cos", "overlap", "ratio", "relevance", F.coalesce("relevance", F.lit(0.0)).alias("label")).cache()


def _ids(c: Corpus, vectors: bool = True) -> list:
    """All queries with a judgment, and a vector where it is needed, by id: splits shuffle them as one list."""
    known = (c.vectors if vectors else c.ids).select("query_id").join(c.qrels.select("query_id"), "query_id", "left_semi")
    return [r.query_id for r in known.distinct().orderBy("query_id").collect()]


def _key(c: Corpus) -> str:
    return c.keys.split(", ")[0]


def _frame(c: Corpus, ids: list) -> DataFrame:
    return c.spark.createDataFrame([(q,) for q in ids], _key(c))


def _train_ids(c: Corpus, vectors: bool = True) -> tuple[list, list]:
    return _given(c, vectors) or base_rate.split_queries(_ids(c, vectors), c.options.ratio, c.options.seed)


def _given(c: Corpus, vectors: bool = True) -> tuple[list, list] | None:
    """The named split, of the queries that take part."""
    known = set(_ids(c, vectors)) if c.options.split else set()
    return tuple([q for q in part if q in known] for part in c.options.split) if c.options.split else None


def _binned(rows: DataFrame, score: str, bins: int) -> DataFrame:
    """(bin, label, score, n): all rows, as the mean score and number of each label's in bins ``1 / bins`` wide.

    Descent sums a smooth function of the score, so what the bins leave out is of the order of
    (slope / bins) ** 2, and the rows of a fit are bounded by the range of the score.
    """
    return rows.groupBy(F.floor(F.col(score) * bins).alias("bin"), "label").agg(F.avg(score).alias("score"), F.count("*").cast("double").alias("n"))


def _model(rows: DataFrame, fit: Callable[[pd.DataFrame], dict], schema: str, order: list[str]) -> dict:
    got = fit_by_group(rows.withColumn("model", F.lit("all")), ["model"], fit, schema, order).collect()
    return got[0].asDict() if got else {}


def _fitted(kind: str):
    def run(c: Corpus) -> DataFrame:
        """A sigmoid fitted on the training queries' documents of a positive score ranks all documents.

        By default the fit sees judged documents only, takes its default rate and steps, and the fitted values
        score term by term; in the reference style unjudged documents are negative, the descent is longer, and one
        posterior of the whole score ranks. Both start from the given values. Fewer than four pairs rank nothing.
        """
        train, rest = (_ids(c, False),) * 2 if kind == "all" else _train_ids(c, False)
        given, whole = c.index.params, c.options.style == "python-reference"
        some = lambda ids: c.queries.join(F.broadcast(_frame(c, ids)), "query_id", "left_semi")
        packed = None if whole else Packed.of(c.index, c.queries)
        if packed:
            pairs = packed.only(train).pairs(c.qrels.join(F.broadcast(_frame(c, train)), "query_id", "left_semi")).where("bm25 > 0")
        else:
            pairs = scoring.sparse_scores(c.index, some(train)).where("bm25 > 0").join(c.qrels, ["query_id", "doc_id"], "left" if whole else "inner")
        pairs = pairs.select("query_id", "doc_id", F.col("bm25").alias("score"), (F.coalesce("relevance", F.lit(0.0)) > 0).cast("double").alias("label"))
        start = (given.alpha, given.beta)
        if whole:

            def fit(p: pd.DataFrame) -> dict:
                s, y, w, n = p.score.to_numpy(), p.label.to_numpy(), p.n.to_numpy(), p.n.sum()
                alpha, beta = descend(np.array(start), lambda t: Transform.gradient(t, s, y, None, w, n), 0.05, 3000, 1e-6)
                return {"alpha": float(alpha), "beta": float(beta), "pairs": int(n)}

            m = _model(_binned(pairs, "score", SPARSE_BINS), fit, "alpha double, beta double, pairs long", ["bin", "label"])
            n, alpha, beta = m.get("pairs", 0), m.get("alpha", start[0]), m.get("beta", start[1])
        else:
            n, alpha, beta = fit_sigmoid_binned(pairs, start=start)
        if n < 4:
            rest = []
        fitted = replace(c.index, params=replace(given, alpha=alpha, beta=beta))
        rows = scoring.sparse_scores(fitted, some(rest))
        score = scoring.overall_posterior(F.col("bm25"), F.col("overlap"), F.col("ratio"), alpha, beta, given.base_rate) if whole else F.col("bayes")
        best = packed.with_params(fitted.params).only(rest).top(c.options.top, "bayes") if packed else None
        return scoring.zero_filled_top(rows.select("query_id", "doc_id", score.alias("score")), _frame(c, rest), c.docs, c.options.top, best=best)

    return run


def _dense_pairs(c: Corpus, train: list) -> DataFrame:
    """(query_id, doc_id, cos, label): the training queries' judged documents and as many of all others as are positive."""
    docs = training.numbered(c.docs).persist()
    order = c.spark.createDataFrame([(q, c.options.seed + i + 1) for i, q in enumerate(train)], f"{_key(c)}, seed long")
    judged = c.qrels.join(F.broadcast(order), "query_id").join(docs, "doc_id").persist()
    label = (F.col("relevance") > 0).cast("double").alias("label")
    others = training.drawn_numbers(judged, docs.count()).join(docs, "at").select("query_id", "doc_id", F.lit(0.0).alias("label"))
    pairs = judged.select("query_id", "doc_id", label).unionByName(others)
    cos = X.cosine(F.col("q"), F.coalesce("embedding", F.array().cast("array<float>")))
    return pairs.join(c.vectors.select("query_id", F.col("embedding").alias("q")), "query_id").join(c.docs.select("doc_id", "embedding"), "doc_id").select("query_id", "doc_id", cos.alias("cos"), "label")


def _dense_calibrated(kind: str):
    def run(c: Corpus) -> DataFrame:
        """The held-out queries' nearest documents by a calibrated cosine; none without ten training pairs of both classes."""
        train, rest = _train_ids(c)
        some = _dense_pairs(c, train).persist()
        seen = some.agg(F.count("*").alias("n"), F.sum("label").alias("positive")).first()
        if seen.n < 10 or not 0 < seen.positive < seen.n:
            rest = []
        if kind == "platt":

            def fit(p: pd.DataFrame) -> dict:
                return vars(Platt().fit(p.score, p.label, weights=p.n))

            m = _model(_binned(some, "cos", DENSE_BINS), fit, "a double, b double", ["bin", "label"])
            score = Platt(m.get("a", 1.0), m.get("b", 0.0)).column(F.col("cos"))
        else:
            blocks = isotonic_blocks(some, "cos", "label", ["query_id", "doc_id"])
            m = _model(blocks, lambda p: vars(Isotonic.of_blocks(p[["total", "n", "low", "high"]].to_numpy().tolist())), "x array<double>, y array<double>", ["part", "nth"])
            score = Isotonic(m.get("x", []), m.get("y", [])).column(F.col("cos"))
        some.unpersist()
        near = c.nearest(c.options.depth, _frame(c, rest)).drop("rank")
        return scoring.top_k(near.withColumn("score", X.clamp(score, 0.0, 1.0)), c.options.top)

    return run


def _scored(c: Corpus, vector: bool) -> DataFrame:
    """Candidates with both probabilities, their relevance (null where unjudged) and the query's features."""
    queries = c.queries.join(c.vectors.select("query_id"), "query_id", "left_semi")
    packed = c.packed()
    rows = c.signals().select("query_id", "doc_id", "rank_sparse", "rank_dense", "bm25", "bayes", "cos").cache()
    sparse, extents = (None, packed.extents()) if packed else (c.sparse(), None)
    features = training.query_features(c.vectors, queries, sparse, c.nearest(10), rows, c.index.docs.count(), DEPTH, extents)
    if vector:
        rows = _vector_probabilities(c, rows).withColumnRenamed("cos", "dense")
    else:
        rows = rows.withColumn("dense", X.cosine_to_probability(F.col("cos")))
    return rows.join(c.qrels, ["query_id", "doc_id"], "left").join(features, "query_id").select("query_id", "doc_id", "bayes", "dense", "relevance", *training.RICH)


def _attention(kind: str, normalize: bool = False, heads: int = 1, vector: bool = False):
    """Query features weigh both signals; normalised models see all seven features, others three.

    Models are fitted in one job, one task a model, and rank in another; a model without enough
    pairs of both classes ranks nothing.
    """
    names = list(training.RICH if normalize else training.BASIC)

    def model() -> MultiHead | AttentionWeights:
        return MultiHead(2, len(names), heads, 0.5, normalize) if heads > 1 else AttentionWeights(2, len(names), 0.5, normalize)

    def run(c: Corpus) -> DataFrame:
        rows = _scored(c, vector).cache()
        train, ranked = training.protocol(_ids(c), kind, c.options.ratio, c.options.seed, given=_given(c))
        order = c.spark.createDataFrame(train, f"model int, {_key(c)}, seed long")
        parts = model().models if heads > 1 else [model()]
        fitted = fit_attention(training.drawn(rows, order), ["bayes", "dense"], names, parts)
        thetas = c.spark.createDataFrame([(m, np.concatenate(t).tolist()) for m, t in fitted.items()], "model int, theta array<double>")
        use = c.spark.createDataFrame(ranked, f"{_key(c)}, model int").join(F.broadcast(thetas), "model")  # a row for each model

        def one(p: pd.DataFrame) -> pd.DataFrame:
            m, p = model(), p.sort_values("doc_id")
            for x, t in zip(m.models if heads > 1 else [m], np.split(np.array(p.theta.iloc[0]), heads), strict=True):
                x.state.theta, x.state.mean = t, t
            out = m.combine(p[["bayes", "dense"]].to_numpy(), p[names].to_numpy()[:1], True)
            return p[["query_id", "doc_id"]].assign(score=out)

        scored = rows.join(use, "query_id").groupBy("query_id").applyInPandas(one, f"{c.keys}, score double")  # a query's candidates: 2 * DEPTH at most
        return scoring.top_k(scored, c.options.top)

    return run


def _learnable(spark: SparkSession, d: str) -> DataFrame:
    """Fusion weights by signal, fitted on all judged candidates."""
    rows = _judged(Corpus.of_tables(spark, d)).select(F.lit(0).alias("model"), "query_id", "doc_id", "bayes", X.cosine_to_probability(F.col("cos")).alias("dense"), "label")
    got = fit_learnable(rows, ["bayes", "dense"]).values()
    return spark.createDataFrame([(round(float(a), 6), round(float(b), 6)) for a, b in got], "sparse_weight double, dense_weight double")


def _vector_probabilities(c: Corpus, rows: DataFrame) -> DataFrame:
    """``cos`` of the candidates calibrated by all documents' distances, the Bayesian score their weight."""
    packed = c.packed()
    got = vector_probabilities(rows, c.docs, c.vectors, packed or c.sparse().select("query_id", "doc_id", F.col("bayes").alias("weight")))
    return rows.drop("cos").join(got, ["query_id", "doc_id"]).select("query_id", "doc_id", "bm25", "bayes", F.col("probability").alias("cos"))


def _vector(method: str):
    def run(c: Corpus) -> DataFrame:
        got = _vector_probabilities(c, c.signals().select("query_id", "doc_id", "bm25", "bayes", "cos").cache())
        if method == "balanced":
            return scoring.top_k(scoring.fuse(got, "balanced_fusion"), c.options.top)
        return scoring.top_k(got.withColumn("score", X.log_odds_conjunction([F.col("bayes"), F.col("cos")], gating="softplus")), c.options.top)

    return run


def _rates(spark: SparkSession, d: str) -> DataFrame:
    """Base rates by the three estimators, and the automatic sigmoid, from pseudo-queries of 50 documents drawn by the seeded shuffle."""
    c = Corpus.of_tables(spark, d)
    n = c.index.docs.count()
    ids = training.drawn_documents(c.index.docs, n, PSEUDO_QUERIES, c.options.seed)
    scores = base_rate.pseudo_scores(c.index, ids).cache()
    auto = base_rate.auto_parameters(scores)
    quantile = base_rate.percentile_rate(scores, n).withColumnRenamed("base_rate", "percentile")
    elbow = base_rate.elbow_rate(scores).withColumnRenamed("base_rate", "elbow")
    mixture = base_rate.mixture_rate(scores).withColumnRenamed("base_rate", "mixture")
    return auto.crossJoin(quantile).crossJoin(elbow).crossJoin(mixture).select(*(F.round(x, 6).alias(x) for x in ("alpha", "beta", "percentile", "elbow", "mixture")))  # one row each


def scorers() -> dict[str, Scorer]:
    """Scorers with a fit."""
    attention = {
        f"bayesian_{name}{end}": _attention(kind, normalize, heads)
        for end, kind in (("", "all"), ("_split", "split"))
        for name, normalize, heads in (("attention", False, 1), ("attn_norm", True, 1), ("multihead", False, 4), ("multihead_norm", True, 4))
    }
    return attention | {
        "bayesian_attn_norm_cv": _attention("cv", True), "bayesian_vector_attn_split": _attention("split", vector=True),
        "bayesian_fitted": _fitted("all"), "bayesian_fitted_split": _fitted("split"), "dense_platt_split": _dense_calibrated("platt"), "dense_isotonic_split": _dense_calibrated("isotonic"),
        "bayesian_vector_balanced": _vector("balanced"), "bayesian_vector_softplus": _vector("softplus"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: shown(f) for n, f in scorers().items()} | {"learnable_weights": _learnable, "base_rates": _rates}


def _rates_sql() -> str:
    """Base rates in SQL, the shuffle and the mixture as recursions."""
    base = _base("lucene").replace("FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM benchmark) GROUP BY ALL)", "FROM (SELECT doc_id AS item_id, unnest(t[1:5]) AS term FROM drawn JOIN toks USING (doc_id)) GROUP BY ALL)")
    base = base.replace("post AS MATERIALIZED", """ids AS MATERIALIZED (SELECT list(doc_id ORDER BY doc_id) AS l, count(*)::BIGINT AS n FROM toks),
shuf(i, state, l) AS (SELECT n - 1, (42 * 1664525 + 1013904223) % 4294967296, l FROM ids UNION ALL
  SELECT i - 1, (state * 1664525 + 1013904223) % 4294967296, list_transform(range(1, len(l) + 1), lambda k: CASE WHEN k = i + 1 THEN l[state % (i + 1) + 1] WHEN k = state % (i + 1) + 1 THEN l[i + 1] ELSE l[k] END) FROM shuf WHERE i > 0),
drawn AS MATERIALIZED (SELECT unnest(l[1:50]) AS doc_id FROM (SELECT l FROM shuf ORDER BY i LIMIT 1)),
post AS MATERIALIZED""")
    log = lambda m, v, p: f"(-0.5::DOUBLE * (x - e.{m}) * (x - e.{m}) / e.{v} - 0.5::DOUBLE * ln(e.{v}) + ln(greatest({p}, 1e-10::DOUBLE)))"
    return f"""WITH RECURSIVE {base},
sc AS MATERIALIZED (SELECT query_id, bm25 AS x FROM sp WHERE bm25 > 0),
auto AS (SELECT CASE WHEN stddev_pop(x) > 0 THEN 1 / stddev_pop(x) ELSE 1 END AS alpha, quantile_cont(x, 0.5) AS beta FROM sc),
cut AS (SELECT query_id, quantile_cont(x, 0.95) AS c FROM sc GROUP BY query_id),
share AS (SELECT count(*) FILTER (round(x, 9) >= round(c, 9)) / (SELECT n FROM st) AS s FROM sc JOIN cut USING (query_id) GROUP BY query_id),
pc AS (SELECT least(greatest(avg(s), 1e-6::DOUBLE), 0.5::DOUBLE) AS percentile FROM share),
curve AS (SELECT x, row_number() OVER (ORDER BY x DESC) - 1 AS p, count(*) OVER () AS n, max(x) OVER () AS hi, min(x) OVER () AS lo FROM sc),
el AS (SELECT least(greatest(greatest(p, 1) / n, 1e-6::DOUBLE), 0.5::DOUBLE) AS elbow FROM curve ORDER BY round(abs((lo - hi) * p - (n - 1) * (x - hi)), 9) DESC, p LIMIT 1),
em(k, m0, m1, v0, v1, s) AS (
  SELECT 0, avg(x) FILTER (x <= beta), avg(x) FILTER (x > beta), greatest(var_pop(x) FILTER (x <= beta), 1e-8::DOUBLE), greatest(var_pop(x) FILTER (x > beta), 1e-8::DOUBLE), 0.5::DOUBLE FROM sc, auto
  UNION ALL SELECT e.k + 1, w.a0 / w.g0, w.a1 / w.g1, greatest(w.b0 / w.g0 - (w.a0 / w.g0) * (w.a0 / w.g0), 1e-8::DOUBLE), greatest(w.b1 / w.g1 - (w.a1 / w.g1) * (w.a1 / w.g1), 1e-8::DOUBLE), w.g1 / w.n
  FROM em e, LATERAL (SELECT sum(1 - g) AS g0, sum(g) AS g1, sum((1 - g) * x) AS a0, sum(g * x) AS a1, sum((1 - g) * x * x) AS b0, sum(g * x * x) AS b1, count(*) AS n FROM (SELECT x, 1 / (1 + exp({log('m0', 'v0', '1 - e.s')} - {log('m1', 'v1', 'e.s')})) AS g FROM sc)) w WHERE e.k < 20),
mx AS (SELECT least(greatest(CASE WHEN m1 >= m0 THEN s ELSE 1 - s END, 1e-6::DOUBLE), 0.5::DOUBLE) AS mixture FROM em WHERE k = 20)
SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(percentile, 6) AS percentile, round(elbow, 6) AS elbow, round(mixture, 6) AS mixture FROM auto, pc, el, mx"""


_SHUFFLED = """shuf(i, state, l) AS (SELECT n - 1, (42 * 1664525 + 1013904223) % 4294967296, l FROM ids UNION ALL
  SELECT i - 1, (state * 1664525 + 1013904223) % 4294967296, list_transform(range(1, len(l) + 1), lambda k: CASE WHEN k = i + 1 THEN l[state % (i + 1) + 1] WHEN k = state % (i + 1) + 1 THEN l[i + 1] ELSE l[k] END) FROM shuf WHERE i > 0)"""


def _fitted_sql(split: bool) -> str:
    """The sigmoid's descent as a recursion, on the judged pairs of the training queries, and the ranking with its values."""
    parts = f"""{_SHUFFLED}, cut AS (SELECT l, least(len(l) - 1, greatest(1, floor(len(l) * 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT)) AS k FROM (SELECT l FROM shuf ORDER BY i LIMIT 1)),
train AS (SELECT unnest(l[1:k]) AS query_id FROM cut), rest AS (SELECT unnest(l[k + 1:]) AS query_id FROM cut)""" if split else "train AS (SELECT unnest(l) AS query_id FROM ids), rest AS (SELECT unnest(l) AS query_id FROM ids)"  # fmt: skip
    like, post = _safe(_sigmoid("f.a * (raw - f.b)")), "l * pr / (l * pr + (1 - l) * (1 - pr))"
    error = f"({_safe(_sigmoid('g.a * (s - g.b)'))} - 1)"
    return f"""WITH RECURSIVE {_base("lucene")},
qr AS MATERIALIZED (SELECT i.item_id AS query_id, d.doc_id FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id JOIN embeddings e ON e.label = q.label JOIN documents d ON d.doc_id = e.vec_id),
ids AS MATERIALIZED (SELECT list(query_id ORDER BY query_id) AS l, count(*)::BIGINT AS n FROM (SELECT DISTINCT query_id FROM qr)),
{parts},
fit AS MATERIALIZED (SELECT bm25 AS s FROM sp JOIN qr USING (query_id, doc_id) JOIN train USING (query_id) WHERE bm25 > 0),
gd(k, a, b, still) AS (SELECT 0, 1.0::DOUBLE, 0.5::DOUBLE, true UNION ALL
  SELECT g.k + 1, g.a - 0.01::DOUBLE * w.da, g.b - 0.01::DOUBLE * w.db, greatest(abs(0.01::DOUBLE * w.da), abs(0.01::DOUBLE * w.db)) >= 1e-6::DOUBLE
  FROM gd g, LATERAL (SELECT sum({error} * (s - g.b)) / count(*) AS da, sum({error} * (0 - g.a)) / count(*) AS db FROM fit) w WHERE g.k < 1000 AND g.still),
f AS MATERIALIZED (SELECT a, b FROM gd ORDER BY k DESC LIMIT 1),
fp AS (SELECT query_id, doc_id, qtf, raw, pr, {like} AS l FROM po, f),
fs AS (SELECT query_id, doc_id, 1 - exp(sum(CASE WHEN raw <> 0 THEN qtf * ln(1 - {_safe(post)}) ELSE 0 END)) AS bayes FROM fp GROUP BY query_id, doc_id),
sc AS (SELECT r.query_id, d.doc_id, coalesce(bayes, 0)::DOUBLE AS score FROM rest r CROSS JOIN documents d LEFT JOIN fs ON fs.query_id = r.query_id AND fs.doc_id = d.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM rk WHERE rank <= 10"""


def _learnable_sql() -> str:
    """The two weights' descent as a recursion."""
    mid = "(w * x0 + (1 - w) * x1)"
    error = f"({_sigmoid(mid)} - y)"
    return f"""WITH RECURSIVE {_base("lucene")}, {_VECTORS}, {_SIGNALS},
x AS MATERIALIZED (SELECT {_logit("bayes")} AS x0, {_logit(_safe("(1 + cos) / 2"))} AS x1, CASE WHEN q.label = d.label THEN 1.0::DOUBLE ELSE 0 END AS y FROM sig JOIN qv q USING (query_id) JOIN dv d USING (doc_id)),
gd(k, z0, z1, still) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, true UNION ALL
  SELECT g.k + 1, g.z0 - 0.1::DOUBLE * m.g0, g.z1 - 0.1::DOUBLE * m.g1, greatest(abs(0.1::DOUBLE * m.g0), abs(0.1::DOUBLE * m.g1)) >= 1e-9::DOUBLE
  FROM gd g, LATERAL (SELECT avg({error} * w * (x0 - {mid})) AS g0, avg({error} * (1 - w) * (x1 - {mid})) AS g1 FROM (SELECT *, 1 / (1 + exp(g.z1 - g.z0)) AS w FROM x)) m WHERE g.k < 300 AND g.still)
SELECT round(1 / (1 + exp(z1 - z0)), 6) AS sparse_weight, round(1 / (1 + exp(z0 - z1)), 6) AS dense_weight FROM gd ORDER BY k DESC LIMIT 1"""


def oracle_sql() -> dict[str, str]:
    """Of the fits the base rates, the sigmoids and the two weights; the tests hold the other models to plain descents."""
    return {"learnable_weights": _learnable_sql(), "base_rates": _rates_sql(), "bayesian_fitted": _fitted_sql(False), "bayesian_fitted_split": _fitted_sql(True)}
