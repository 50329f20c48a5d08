"""The registered retrieval queries: documents searched with the benchmark items, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import tokenize
from ..operators import metrics, scoring
from ..operators.blocksearch import BlockIndex, PackedBlocks, block_bounds_of
from ..operators.dense import best_documents, cosines
from ..operators.index import Index, Params, block_max
from ..operators.packed import Packed, groups
from ..operators.selfcheck import SelfCheck

DEPTH, TOP, BASE_RATE = 100, 10, 0.05


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@dataclass(frozen=True)
class Options:
    """How deep scorers rank, what they fuse, and how fitted ones split the queries (``split`` names both parts)."""

    top: int = TOP
    depth: int = DEPTH
    base_rate: float | None = BASE_RATE
    ratio: float = 0.5
    seed: int = 42
    split: tuple[list, list] | None = None
    style: str = "pytrec"


class Corpus:
    """What every scorer reads: docs(doc_id, text, embedding[, terms]), queries(query_id, text, embedding[, terms])
    and qrels(query_id, doc_id, relevance). Queries with a null vector take part in sparse scoring only.
    ``texts`` may name the texts of docs without the join with their vectors: then they need no shuffle."""

    def __init__(self, docs: DataFrame, queries: DataFrame, qrels: DataFrame, params: Params | None = None, options: Options | None = None, texts: DataFrame | None = None):
        terms = lambda df: "terms" if "terms" in df.columns else None
        self.spark, self.qrels, self.options = docs.sparkSession, qrels, options or Options()
        texts = docs if texts is None else texts
        self.index = Index.build(texts, terms=terms(texts), params=params or Params(method="lucene"))
        self.queries = scoring.query_terms(queries, terms=terms(queries))
        self.ids = queries.select("query_id")
        stats = F.broadcast(self.index.corpus_stats())
        rows = self.index.docs.crossJoin(stats).select("doc_id", F.when(F.col("avgdl") > 0, F.col("doc_len") / F.col("avgdl")).otherwise(1.0).alias("doc_ratio"))
        self.docs = rows.join(docs.select("doc_id", "embedding"), "doc_id")
        self.vectors = queries.where("embedding is not null").select("query_id", "embedding")
        kinds = [df.select(c).schema[0].dataType.simpleString() for df, c in ((queries, "query_id"), (docs, "doc_id"))]
        self.keys = f"query_id {kinds[0]}, doc_id {kinds[1]}"
        self._kept: dict[str, Packed | None] = {}

    @classmethod
    def of_tables(cls, spark: SparkSession, d: str, params: Params | None = None) -> Corpus:
        """One data set: documents and items with the vectors of their ids; an item's relevant documents
        are those whose vector has its vector's label."""
        vec = _read(spark, d, "embeddings").select("vec_id", "embedding", "label")
        texts = _read(spark, d, "documents").select("doc_id", "text")
        docs = texts.join(vec, F.col("doc_id") == F.col("vec_id"), "left")
        items = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vec, F.col("query_id") == F.col("vec_id"), "left")
        wanted = items.where("vec_id is not null").select("query_id", F.col("label").alias("l"))
        qrels = wanted.join(docs.select("doc_id", "label"), F.col("label") == F.col("l")).select("query_id", "doc_id", F.lit(1.0).alias("relevance"))
        return cls(docs, items, qrels, params, texts=texts)

    def packed(self) -> Packed | None:
        """The documents packed by the queries' terms, made once; None for too many queries, which are left to :meth:`sparse`."""
        if "packed" not in self._kept:
            self._kept["packed"] = Packed.of(self.index, self.queries)
        got = self._kept["packed"]
        return got and got.with_params(self.index.params)

    def sparse(self) -> DataFrame:
        """A row for each query and document that share a term."""
        return scoring.sparse_scores(self.index, self.queries)

    def dense(self) -> DataFrame:
        """Every cosine, a row each: for checks of a few queries."""
        return cosines(self.docs, self.vectors)

    def nearest(self, k: int, queries: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, cos, rank): the ``k`` best documents by cosine of all queries, or of ``queries``(query_id)."""
        vectors = self.vectors if queries is None else self.vectors.join(F.broadcast(queries), "query_id", "left_semi")
        return scoring.top_k(best_documents(self.docs, vectors, k), k, "cos")

    def signals(self, packed: Packed | None = None) -> DataFrame:
        packed = packed or self.packed()
        sparse = None if packed else self.sparse().join(self.vectors.select("query_id"), "query_id")
        return scoring.signals(sparse, self.vectors, self.docs, self.options.depth, packed)


def _shown(ranked: DataFrame, score: str = "score") -> DataFrame:
    return ranked.select("query_id", "doc_id", "rank", F.round(score, 6).alias("score"))


Scorer = Callable[[Corpus], DataFrame]


def _sparse(column: str) -> Scorer:
    """The best documents of each query by a sparse score; those without a match score 0."""

    def run(c: Corpus) -> DataFrame:
        whole = column == "overall" or (column == "bayes" and c.options.style == "python-reference")
        packed = None if whole else c.packed()
        if packed:
            return scoring.zero_filled_top(None, c.ids, c.docs, c.options.top, best=packed.top(c.options.top, column), packed=packed)
        rows = c.sparse()
        value = scoring.overall_posterior(F.col("bm25"), F.col("overlap"), F.col("ratio"), c.index.params.alpha, c.index.params.beta, c.index.params.base_rate) if whole else F.col(column)
        return scoring.zero_filled_top(rows.select("query_id", "doc_id", value.alias("score")), c.ids, c.docs, c.options.top)

    return run


def _no_base_rate(c: Corpus) -> DataFrame:
    """The Bayesian score without the base rate that the others may have."""
    plain = copy(c)
    plain.index = replace(c.index, params=replace(c.index.params, base_rate=None))
    return _sparse("bayes")(plain)


def _dense(c: Corpus) -> DataFrame:
    return c.nearest(c.options.top).withColumnRenamed("cos", "score")


def _fused(method: str) -> Scorer:
    return lambda c: scoring.top_k(scoring.fuse(c.signals(), method, base_rate=c.options.base_rate), c.options.top)


def scorers() -> dict[str, Scorer]:
    """Scorers that need no fit."""
    return {"bm25": _sparse("bm25"), "bayesian": _sparse("bayes"), "bayesian_no_base_rate": _no_base_rate, "bayesian_overall": _sparse("overall"), "dense": _dense} | {m: _fused(m) for m in scoring.METHODS}


def shown(scorer: Scorer, params: Params | None = None):
    """A scorer as a registered query."""
    return lambda spark, d: _shown(scorer(Corpus.of_tables(spark, d, params)))


def _metrics(style: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = Corpus.of_tables(spark, d)
        ranked = scoring.top_k(scoring.fuse(c.signals(), "rrf"), TOP)
        got = metrics.mean_metrics(metrics.ranking_metrics(ranked, c.qrels, [5, 10], style))
        return got.select("cutoff", "queries", *(F.round(m, 6).alias(m) for m in ("ndcg", "map", "mrr", "recall")))

    return run


def _pairs(c: Corpus) -> DataFrame:
    rows = c.signals().join(c.qrels, ["query_id", "doc_id"], "left")
    return rows.select(F.round("bayes", 9).alias("p"), F.coalesce("relevance", F.lit(0.0)).alias("y"))


def _calibration(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.calibration(_pairs(Corpus.of_tables(spark, d)))
    return out.select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), "samples")


def _reliability(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.reliability(_pairs(Corpus.of_tables(spark, d)))
    return out.select("bin", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"), "n")


def _term_stats(spark: SparkSession, d: str) -> DataFrame:
    index = Index.build(_read(spark, d, "documents"))
    return index.term_stats(index.postings())


def _corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return Index.build(_read(spark, d, "documents")).corpus_stats().select(F.col("n").cast("long").alias("n"), F.round("avgdl", 6).alias("avgdl"))


def _block_max(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus.of_tables(spark, d)
    rows = scoring.term_scores(c.index, c.queries).select("term", F.col("doc_id").alias("doc_ord"), F.col("raw").alias("score")).distinct()
    return block_max(rows, 64).select("term", "block_id", F.round("max_score", 6).alias("max_score"))


def _block_search(score: str):
    """The best matches through block bounds, of packed blocks of the query terms. A query set too large for that is searched
    group by group: where the session names a folder for checkpoints, a group's matches are stored and its blocks released
    before the next one's are made. A single query too large for it goes through the blocks' postings, checkpointed likewise."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        index = Index.build(_read(spark, d, "documents"), params=Params(method="lucene"))
        asked = scoring.query_terms(_read(spark, d, "benchmark"), query_id="item_id")
        packed = Packed.of(index, asked)
        if packed:
            return _shown(PackedBlocks.of(packed).search(TOP, score))
        stores, found = spark.conf.get("spark.checkpoint.dir", None), []
        for some in groups(asked):
            packed = Packed.of(index, some)
            if packed is None:
                built = BlockIndex.build(index)
                if stores:
                    stored = built.postings.checkpoint()
                    built = replace(built, postings=stored, blocks=block_bounds_of(stored))
                found.append(built.search(some, TOP, score))
                continue
            blocks = PackedBlocks.of(packed)
            best = blocks.search(TOP, score)
            if stores:
                best = best.checkpoint()
                blocks.release()
            found.append(best)
        return _shown(reduce(DataFrame.unionByName, found))

    return run


FIELDS = {"title": 0.2, "body": 0.8}


def _field_scores(spark: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    """Scores over two fields of the documents, the first line and the rest."""
    text = F.coalesce("text", F.lit(""))
    rest = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise("")
    parts = _read(spark, d, "documents").select("doc_id", tokenize(F.substring_index(text, "\n", 1)).alias("title"), tokenize(rest).alias("body"))
    return scoring.field_scores(parts, queries, FIELDS, Params(method="lucene"))


def _multi_field(spark: SparkSession, d: str) -> DataFrame:
    rows = _field_scores(spark, d, scoring.query_terms(_read(spark, d, "benchmark"), query_id="item_id"))
    return _shown(scoring.top_k(rows, TOP))


def _multi_field_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The fields' score fused with the cosine over the best candidates of both."""
    c = Corpus.of_tables(spark, d)
    rows = _field_scores(spark, d, c.queries.join(c.vectors.select("query_id"), "query_id", "left_semi"))
    sparse = rows.select("query_id", "doc_id", F.col("score").alias("bm25"), F.col("score").alias("bayes"), F.lit(0).alias("overlap"), F.lit(None).cast("double").alias("ratio"))
    return _shown(scoring.top_k(scoring.fuse(scoring.signals(sparse, c.vectors, c.docs, DEPTH), "balanced_fusion"), TOP))


def _by_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of three scorers, as one table of runs."""
    c = Corpus.of_tables(spark, d)
    known = scorers()
    runs = reduce(DataFrame.unionByName, [known[n](c).select(F.lit(n).alias("scorer"), "query_id", "doc_id", "score") for n in ("bm25", "dense", "rrf")]).persist()  # 2 * DEPTH + 2 * TOP rows a query at most
    got = metrics.evaluate(runs.join(c.vectors.select("query_id"), "query_id", "left_semi"), c.qrels, [10])
    return got.select("scorer", "cutoff", "queries", *(F.round(m, 6).alias(m) for m in ("ndcg", "map", "mrr", "recall")))


def _self_checks(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus.of_tables(spark, d)
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    packed = Packed.of(c.index, c.queries)
    signals = c.signals(packed).persist()  # the candidates: 2 * DEPTH rows a query at most; a checkpoint keeps plans short
    signals = signals.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else signals
    return SelfCheck(c.index, items, signals, c.qrels, packed).run_all()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known, lucene, robertson = scorers(), Params(method="lucene"), Params(method="robertson")
    rated = Params(method="lucene", base_rate=BASE_RATE)
    return {n: shown(f) for n, f in known.items()} | {
        "bm25": shown(known["bm25"], robertson), "bm25_lucene": shown(known["bm25"], lucene), "bayesian_robertson": shown(known["bayesian"], robertson), "bayesian_no_base_rate": shown(known["bayesian"], lucene), "bayesian": shown(known["bayesian"], lucene), "bayesian_base_rate": shown(known["bayesian"], rated),
        "bayesian_multifield": _multi_field, "bayesian_multifield_bal": _multi_field_balanced, "metrics_pytrec": _metrics("pytrec"), "metrics_reference": _metrics("python-reference"), "metrics_by_scorer": _by_scorer,
        "calibration": _calibration, "reliability": _reliability, "term_stats": _term_stats, "corpus_stats": _corpus_stats, "block_max": _block_max, "block_search_bm25": _block_search("bm25"), "block_search_bayesian": _block_search("bayes"), "self_checks": _self_checks,
    }


# --- the same in SQL ---------------------------------------------------------------------------

def _safe(x: str) -> str:
    return f"least(greatest({x}, 1e-10::DOUBLE), (1 - 1e-10::DOUBLE))"


def _logit(x: str) -> str:
    return f"ln({_safe(x)} / (1 - {_safe(x)}))"


def _sigmoid(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"


def _base(method: str, text: str = "text", source: str = "documents", tag: str = "", rate: float | None = None) -> str:
    """CTEs up to sp<tag>(query_id, doc_id, bm25, bayes, overlap, ratio)."""
    t = tag
    idf = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))" if method == "lucene" else "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
    factor = "1.0::DOUBLE" if method == "lucene" else "2.2::DOUBLE"
    prior = "least(greatest(0.7::DOUBLE * (0.2::DOUBLE + 0.7::DOUBLE * least(tf / 10.0::DOUBLE, 1.0::DOUBLE)) + 0.3::DOUBLE * (CASE WHEN avgdl < 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE + 0.6::DOUBLE * (1 - least(abs(ratio - 0.5::DOUBLE) * 2, 1.0::DOUBLE)) END), 0.1::DOUBLE), 0.9::DOUBLE)"
    post = "l * pr / (l * pr + (1 - l) * (1 - pr))"
    if rate is not None:
        post = f"({post}) * {rate}::DOUBLE / (({post}) * {rate}::DOUBLE + (1 - ({post})) * (1 - {rate}::DOUBLE))"
    return f"""
toks{t} AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM {source}),
st{t} AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, coalesce(avg(len(t)), 0)::DOUBLE AS avgdl FROM toks{t}),
dr{t} AS MATERIALIZED (SELECT doc_id, CASE WHEN avgdl > 0 THEN len(t)::DOUBLE / avgdl ELSE 1.0::DOUBLE END AS ratio FROM toks{t}, st{t}),
post{t} AS MATERIALIZED (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks{t}) GROUP BY ALL),
dfs{t} AS MATERIALIZED (SELECT term, count(*)::DOUBLE AS df FROM post{t} GROUP BY term),
qt{t} AS MATERIALIZED (SELECT item_id AS query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM benchmark) GROUP BY ALL),
ts{t} AS MATERIALIZED (SELECT query_id, doc_id, term, qtf, tf, ratio, avgdl, {idf} * (tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ratio) + tf)) * {factor} AS raw
  FROM post{t} JOIN dfs{t} USING (term) JOIN qt{t} USING (term) JOIN dr{t} USING (doc_id), st{t}),
po{t} AS MATERIALIZED (SELECT *, {_safe(_sigmoid('raw - 0.5::DOUBLE'))} AS l, {_safe(prior)} AS pr FROM ts{t}),
sp{t} AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * raw) AS bm25,
  1 - exp(sum(CASE WHEN raw <> 0 THEN qtf * ln(1 - {_safe(post)}) ELSE 0 END)) AS bayes, count(*)::DOUBLE AS overlap, any_value(ratio) AS ratio FROM po{t} GROUP BY query_id, doc_id)"""


_VECTORS = """
dv AS MATERIALIZED (SELECT d.doc_id, e.embedding::DOUBLE[] AS e, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
qv AS MATERIALIZED (SELECT i.item_id AS query_id, e.embedding::DOUBLE[] AS e, e.label FROM benchmark i JOIN embeddings e ON e.vec_id = i.item_id),
de AS MATERIALIZED (SELECT query_id, doc_id, coalesce(CASE WHEN len(dv.e) = 0 OR dv.e IS NULL THEN 0 ELSE list_cosine_similarity(qv.e, dv.e) END, 0)::DOUBLE AS cos FROM qv, dv)"""

_SIGNALS = f"""
ra AS MATERIALIZED (SELECT de.query_id, de.doc_id, cos, coalesce(bm25, 0)::DOUBLE AS bm25, coalesce(bayes, 0)::DOUBLE AS bayes, coalesce(overlap, 0)::DOUBLE AS overlap, dr.ratio,
  row_number() OVER (PARTITION BY de.query_id ORDER BY round(coalesce(bm25, 0), 9) DESC, de.doc_id) AS rs,
  row_number() OVER (PARTITION BY de.query_id ORDER BY round(cos, 9) DESC, de.doc_id) AS rd
  FROM de LEFT JOIN sp USING (query_id, doc_id) JOIN dr USING (doc_id)),
sig AS MATERIALIZED (SELECT * FROM ra WHERE rs <= {DEPTH} OR rd <= {DEPTH})"""


def _ranked(select: str, ctes: str) -> str:
    return f"WITH {ctes}, sc AS (SELECT query_id, doc_id, {select}), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM rk WHERE rank <= {TOP}"


def _conjunction(ps: list[str], gate: Callable[[str], str] = lambda x: x) -> str:
    total = " + ".join(gate(_logit(p)) for p in ps)
    return _sigmoid(f"(({total}) / {len(ps)} * sqrt({len(ps)}::DOUBLE))")


def _gates() -> dict[str, Callable[[str], str]]:
    return {
        "relu": lambda x: f"greatest({x}, 0.0::DOUBLE)",
        "swish": lambda x: f"(({x}) * {_sigmoid(x)})",
        "gelu": lambda x: f"(({x}) * {_sigmoid(f'1.702::DOUBLE * ({x})')})",
        "swish_b2": lambda x: f"(({x}) * {_sigmoid(f'2 * ({x})')})",
        "softplus": lambda x: f"(CASE WHEN ({x}) > 50 THEN ({x}) WHEN ({x}) < -50 THEN exp({x}) ELSE ln(1 + exp({x})) END)",
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    pairs = "FROM (SELECT i.item_id AS query_id, d.doc_id, s.bm25, s.bayes FROM benchmark i CROSS JOIN documents d LEFT JOIN sp s ON s.query_id = i.item_id AND s.doc_id = d.doc_id)"
    for name, method, col in (("bm25", "robertson", "bm25"), ("bm25_lucene", "lucene", "bm25"), ("bayesian", "lucene", "bayes"), ("bayesian_robertson", "robertson", "bayes")):
        out[name] = _ranked(f"coalesce({col}, 0)::DOUBLE AS score {pairs}", _base(method))
    out["bayesian_no_base_rate"] = out["bayesian"]
    out["bayesian_base_rate"] = _ranked(f"coalesce(bayes, 0)::DOUBLE AS score {pairs}", _base("lucene", rate=BASE_RATE))
    whole = "least(greatest(0.7::DOUBLE * (0.2::DOUBLE + 0.7::DOUBLE * least(overlap / 10.0::DOUBLE, 1.0::DOUBLE)) + 0.3::DOUBLE * (0.3::DOUBLE + 0.6::DOUBLE * (1 - least(abs(ratio - 0.5::DOUBLE) * 2, 1.0::DOUBLE))), 0.1::DOUBLE), 0.9::DOUBLE)"
    like = _safe(_sigmoid("bm25 - 0.5::DOUBLE"))
    out["bayesian_overall"] = _ranked(f"CASE WHEN coalesce(bm25, 0) = 0 THEN 0 ELSE {like} * {whole} / ({like} * {whole} + (1 - {like}) * (1 - {whole})) END AS score {pairs.replace('s.bayes', 's.overlap, s.ratio')}", _base("lucene"))
    out["dense"] = _ranked("cos AS score FROM de", _VECTORS)
    ctes = f"{_base('lucene')}, {_VECTORS}, {_SIGNALS}"
    over = "OVER (PARTITION BY query_id)"
    mm = lambda x: f"(CASE WHEN max({x}) {over} - min({x}) {over} < 1e-12 THEN 0.0::DOUBLE ELSE (({x}) - min({x}) {over}) / (max({x}) {over} - min({x}) {over}) END)"
    v, cp = "least(greatest((1 + cos) / 2, 0.0::DOUBLE), 1.0::DOUBLE)", _safe("(1 + cos) / 2")
    select = {
        "convex": f"0.5::DOUBLE * {mm('cos')} + 0.5::DOUBLE * {mm('bm25')}",
        "hybrid_or": f"1 - exp(ln(1 - {_safe('bayes')}) + ln(1 - {_safe(v)}))",
        "hybrid_and": f"CASE WHEN bayes < 1e-10 AND {v} < 1e-10 THEN 0 ELSE {_conjunction(['bayes', v])} END",
        "balanced_fusion": f"0.5::DOUBLE * {mm(_logit(cp))} + 0.5::DOUBLE * {mm(_logit('bayes'))}",
        "rrf": f"(CASE WHEN rs <= {DEPTH} THEN 1.0::DOUBLE / (60 + rs) ELSE 0 END) + (CASE WHEN rd <= {DEPTH} THEN 1.0::DOUBLE / (60 + rd) ELSE 0 END)",
    }
    prior = "least(greatest(0.7::DOUBLE * (0.2::DOUBLE + 0.7::DOUBLE * least(overlap / 10.0::DOUBLE, 1.0::DOUBLE)) + 0.3::DOUBLE * (0.3::DOUBLE + 0.6::DOUBLE * (1 - least(abs(ratio - 0.5::DOUBLE) * 2, 1.0::DOUBLE))), 0.1::DOUBLE), 0.9::DOUBLE)"
    for name, rate in (("bayesian_logodds", "0"), ("bayesian_logodds_br", _logit("0.05::DOUBLE"))):
        med, sd = f"coalesce(quantile_cont(cos, 0.5) FILTER (cos > 0) {over}, 0)", f"stddev_pop(cos) FILTER (cos > 0) {over}"
        dense = f"least(greatest((CASE WHEN {sd} > 0 THEN 1 / ({sd}) ELSE 1 END) * (cos - {med}), -500), 500)"
        sparse = f"least(greatest(bm25 - 0.5::DOUBLE + {_logit(prior)} + {rate}, -500), 500)"
        select[name] = f"{_sigmoid('raw')} AS score FROM (SELECT query_id, doc_id, CASE WHEN bm25 > 0 THEN (0.5::DOUBLE * {dense} + 0.5::DOUBLE * {sparse}) * sqrt(2::DOUBLE) ELSE 0.5::DOUBLE * {dense} END AS raw FROM sig)"
    for kind, gate in _gates().items():
        select[f"bayesian_gated_{kind}"] = _conjunction(["bayes", cp], gate)
    for name, s in select.items():
        out[name] = _ranked(s if " AS score FROM" in s else f"{s} AS score FROM sig", ctes)
    top = f"{ctes}, sc AS (SELECT query_id, doc_id, {select['rrf']} AS score FROM sig), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc), qr AS (SELECT q.query_id, d.doc_id FROM qv q JOIN dv d ON q.label = d.label), ks AS (SELECT unnest([5, 10]) AS k), rel AS (SELECT query_id, count(*) AS m FROM qr GROUP BY 1), hits AS (SELECT rk.query_id, rank, qr.doc_id IS NOT NULL AS hit, sum((qr.doc_id IS NOT NULL)::INT) OVER (PARTITION BY rk.query_id ORDER BY rank) AS h FROM rk LEFT JOIN qr USING (query_id, doc_id) WHERE rank <= 10)"
    for name, ideal, full in (("metrics_pytrec", "least(m, k)", "m"), ("metrics_reference", "found", "found")):
        out[name] = f"WITH {top}, q AS (SELECT query_id, k, any_value(m) AS m, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN hit THEN h / rank ELSE 0 END) AS ap, min(CASE WHEN hit THEN rank END) AS first, sum(hit::INT) AS found FROM rel JOIN hits USING (query_id) JOIN ks ON rank <= k GROUP BY query_id, k) SELECT k::INTEGER AS cutoff, count(*) AS queries, round(avg(CASE WHEN {ideal} > 0 THEN dcg / list_sum(list_transform(range(1, ({ideal} + 1)::BIGINT), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN {full} > 0 THEN ap / {full} ELSE 0 END), 6) AS map, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(found / m), 6) AS recall FROM q GROUP BY k"
    pr = f"{ctes}, pr AS (SELECT round(bayes, 9) AS p, CASE WHEN q.label = d.label THEN 1.0::DOUBLE ELSE 0 END AS y FROM sig JOIN qv q USING (query_id) JOIN dv d USING (doc_id)), bn AS (SELECT i AS bin, avg(p) AS mean_p, avg(y) AS mean_y, count(*) AS n FROM pr JOIN (SELECT unnest(range(10))::INTEGER AS i) ON p <= (i + 1)::DOUBLE / 10 AND (p > i::DOUBLE / 10 OR (i = 0 AND p >= 0)) GROUP BY i)"
    out["reliability"] = f"WITH {pr} SELECT bin, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, n FROM bn"
    out["calibration"] = f"WITH {pr} SELECT round((SELECT sum(n * abs(mean_p - mean_y)) FROM bn) / count(*), 6) AS ece, round(avg((p - y) ** 2), 6) AS brier, count(*) AS samples FROM pr"
    out["term_stats"] = "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM documents) GROUP BY term"
    out["corpus_stats"] = "SELECT count(*) AS n, round(avg(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))), 6) AS avgdl FROM documents"
    out["block_max"] = f"WITH {_base('lucene')} SELECT term, (doc_id // 64)::BIGINT AS block_id, round(max(raw), 6) AS max_score FROM ts GROUP BY 1, 2"
    for name, col in (("bm25", "bm25"), ("bayesian", "bayes")):
        out[f"block_search_{name}"] = _ranked(f"{col} AS score FROM sp", _base("lucene"))
    split = "(SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, CASE WHEN instr(coalesce(text, ''), chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM documents)"
    fields = f"{_base('lucene', 'title', split, '1')}, {_base('lucene', 'body', split, '2')}"
    raw = f"(0.8::DOUBLE * {_logit('coalesce(b.bayes, 0)')} + 0.2::DOUBLE * {_logit('coalesce(a.bayes, 0)')}) * sqrt(2::DOUBLE)"
    both = f"{fields}, {_VECTORS}, dr AS (SELECT doc_id, 1.0::DOUBLE AS ratio FROM documents), mf AS (SELECT query_id, doc_id, {_sigmoid(raw)} AS s FROM (SELECT * FROM sp1) a FULL OUTER JOIN (SELECT * FROM sp2) b USING (query_id, doc_id)), sp AS MATERIALIZED (SELECT query_id, doc_id, s AS bm25, s AS bayes, 0 AS overlap FROM mf), {_SIGNALS}"
    out["bayesian_multifield_bal"] = _ranked(f"{select['balanced_fusion']} AS score FROM sig", both)
    some = "UNION ALL ".join(f"SELECT '{n}' AS scorer, query_id, doc_id, {x} AS score FROM {t} " for n, x, t in (("bm25", "coalesce(bm25, 0)::DOUBLE", "de LEFT JOIN sp USING (query_id, doc_id)"), ("dense", "cos", "de"), ("rrf", select["rrf"], "sig")))
    out["metrics_by_scorer"] = f"WITH {ctes}, runs AS ({some}), rk AS (SELECT *, row_number() OVER (PARTITION BY scorer, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM runs), qr AS (SELECT q.query_id, d.doc_id FROM qv q JOIN dv d ON q.label = d.label), rel AS (SELECT query_id, count(*) AS m FROM qr GROUP BY 1), hits AS (SELECT rk.scorer, rk.query_id, rank, qr.doc_id IS NOT NULL AS hit, sum((qr.doc_id IS NOT NULL)::INT) OVER (PARTITION BY rk.scorer, rk.query_id ORDER BY rank) AS h FROM rk LEFT JOIN qr USING (query_id, doc_id) WHERE rank <= 10), q AS (SELECT scorer, query_id, any_value(m) AS m, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN hit THEN h / rank ELSE 0 END) AS ap, min(CASE WHEN hit THEN rank END) AS first, sum(hit::INT) AS found FROM rel JOIN hits USING (query_id) GROUP BY scorer, query_id) SELECT scorer, 10::INTEGER AS cutoff, count(*) AS queries, round(avg(dcg / list_sum(list_transform(range(1, least(m, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(ap / m), 6) AS map, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(found / m), 6) AS recall FROM q GROUP BY scorer"
    out["bayesian_multifield"] = _ranked(f"{_sigmoid(raw)} AS score FROM (SELECT * FROM sp1) a FULL OUTER JOIN (SELECT * FROM sp2) b USING (query_id, doc_id)", fields)
    return out
