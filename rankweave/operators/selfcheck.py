"""Properties that the scores of any corpus must have, each a query of (passed, tested).

Checks on data are aggregates over matched rows, so they run on a corpus of any size; checks of
formulas run over small grids.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .index import Index, Params, idf
from .learners import learn_parameters
from .packed import Packed
from .scoring import _prior, bm25_of, min_max, query_terms, sparse_scores, term_scores, top_k

EPS = X.EPSILON


def _holds(rows: DataFrame, condition: Column, times: Column | None = None) -> DataFrame:
    """One row: whether ``condition`` holds everywhere (it does on no rows; null counts as broken), and on how many; a row may stand for ``times`` rows."""
    tested = F.count("*") if times is None else F.coalesce(F.sum(times), F.lit(0))
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True)).alias("passed"), tested.alias("tested"))


def _grid(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split()))


def _within(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return (c >= low - EPS) & (c <= high + EPS) & ~F.isnan(c)


class SelfCheck:
    """The thirteen checks over an index, queries(query_id, text) and signals(query_id, doc_id, bm25, bayes, cos).

    ``relevant``(query_id, doc_id) labels the rows that the parameter fit learns from; it takes the
    candidates of one query, so its training set is as small as the candidate depth. With ``packed``, of the
    same index and queries, a posting is checked once for all queries that ask for its term.
    """

    def __init__(self, index: Index, queries: DataFrame, signals: DataFrame, relevant: DataFrame, packed: Packed | None = None):
        self.index, self.signals, self.relevant = index, signals, relevant
        self.spark = queries.sparkSession
        self.queries = query_terms(queries)
        self.packed = packed
        if packed is None:
            self.matched = term_scores(index, self.queries).withColumn("asked", F.lit(1))
        else:
            ratio, raw = bm25_of(index.params)
            self.matched = packed.postings().select("doc_id", "term", "tf", ratio.alias("ratio"), raw.alias("raw"), "asked")
        #: Documents of a term: a packed posting stands once for each.
        self.n_docs = F.countDistinct("doc_id") if packed is None else F.count("*")

    def formula_equivalence(self) -> DataFrame:
        """BM25 as a product and as the weight less what saturation takes away."""
        p = self.index.params
        stats, df = F.broadcast(self.index.corpus_stats()), self.matched.groupBy("term").agg(self.n_docs.alias("df"))
        rows = self.matched.join(df if self.packed is None else F.broadcast(df), "term").crossJoin(stats.select("n"))
        room = p.k1 * (1.0 - p.b + p.b * F.col("ratio"))
        weight = idf(F.col("n"), F.col("df"), p.method) * (1.0 if p.method == "lucene" else p.k1 + 1.0)
        return _holds(rows, F.abs(weight - weight * room / (room + F.col("tf")) - F.col("raw")) < 1e-10, F.col("asked"))

    def score_range(self) -> DataFrame:
        """Probabilities lie in [0, 1], and no match means 0."""
        return _holds(self.signals, _within(F.col("bayes")) & ((F.col("bm25") != 0) | (F.col("bayes") == 0)))

    def monotonicity(self) -> DataFrame:
        """Among documents of the same length a term's score grows with its frequency."""
        p = self.index.params
        like = X.likelihood(F.col("raw"), p.alpha, p.beta)
        post = X.posterior(like, _prior(F.col("tf"), F.col("ratio"), F.lit(1.0)), p.base_rate, safe=False)
        rows = self.matched.where("raw > 0").groupBy("term", "ratio", "tf").agg(F.first(post).alias("p"))  # a row for each length and frequency
        w = Window.partitionBy("term", "ratio").orderBy("tf")
        return _holds(rows.withColumn("before", F.lag("p").over(w)).where("before is not null"), F.col("p") >= F.col("before") - EPS)

    def prior_bounds(self) -> DataFrame:
        return _holds(self.matched, _within(X.composite_prior(F.col("tf"), F.col("ratio")), 0.1, 0.9), F.col("asked"))

    def idf_properties(self) -> DataFrame:
        """Weights of terms in at most half of the documents are not negative, fall with frequency, and bound every score."""
        p = self.index.params
        stats = F.broadcast(self.index.corpus_stats())
        rows = self.matched.groupBy("term").agg(self.n_docs.alias("df"), F.max("raw").alias("most")).crossJoin(stats.select("n"))
        rows = rows.withColumn("w", idf(F.col("n"), F.col("df"), p.method))
        bound = F.greatest(F.col("w"), F.lit(0.0)) * (1.0 if p.method == "lucene" else p.k1 + 1.0)
        more = idf(F.col("n"), F.col("df") + 1, p.method)
        return _holds(rows, ((F.col("df") > F.col("n") / 2) | (F.col("w") >= -EPS)) & (more <= F.col("w") + EPS) & (F.col("most") <= bound + EPS))

    @staticmethod
    def _bounds(ps: list[Column]) -> Column:
        """AND below OR, OR above each signal, agreement amplified, irrelevance kept."""
        both, either = X.log_odds_conjunction(ps), X.prob_or(ps)
        mean = F.pow(reduce(lambda a, b: a * b, ps), F.lit(1.0 / len(ps)))
        high, low = reduce(lambda a, b: a & b, [p > 0.5 for p in ps]), reduce(lambda a, b: a & b, [p < 0.5 for p in ps])
        most = F.greatest(*ps) if len(ps) > 1 else ps[0]
        return (both <= either + EPS) & (either >= most - EPS) & (~high | (both >= mean - EPS)) & (~low | (both <= 0.5 + EPS))

    def hybrid_quality(self) -> DataFrame:
        return _holds(self.signals, self._bounds([F.col("bayes"), X.vector_probability(F.col("cos"))]))

    def method_comparison(self) -> DataFrame:
        """Always passes; counts the documents that some method puts among its five best."""
        sig, v = self.signals, X.vector_probability(F.col("cos"))
        scores = {"bm25": F.col("bm25"), "bayesian": F.col("bayes"), "vector": v, "or": X.prob_or([F.col("bayes"), v]), "and": X.log_odds_conjunction([F.col("bayes"), v]), "naive": F.col("bm25") + v}
        best = [top_k(sig.select("query_id", "doc_id", s.alias("score")), 5).select("query_id", "doc_id") for s in scores.values()]
        return _holds(reduce(DataFrame.union, best).distinct(), F.lit(True))

    def numeric_stability(self) -> DataFrame:
        rows = _grid(self.spark, [(p, x) for p in (1e-15, 1e-10, 1e-5, 0.001, 0.5, 0.999, 1 - 1e-10) for x in (-700.0, -100.0, -1.0, 0.0, 1.0, 100.0, 700.0)], "p x")
        p, x = F.col("p"), F.col("x")
        logs = reduce(lambda a, b: a & b, [F.abs(X.safe_log(F.lit(v))) < 1e3 for v in (0.0, 1e-300, 1e-15, 0.5, 1.0)])
        return _holds(rows, _within(X.log_odds_conjunction([p, p])) & _within(X.prob_or([p, p])) & _within(X.sigmoid(x)) & logs)

    def parameter_learning(self) -> DataFrame:
        """The loss of the fitted sigmoid falls, and in four steps of five.

        Scores are taken over their largest, as descent at a fixed rate need not fall on scores of any size.
        """
        first = self.signals.agg(F.min("query_id").alias("query_id"))
        rows = self.signals.join(first, "query_id").join(self.relevant.select("query_id", "doc_id", F.lit(1.0).alias("y")), ["query_id", "doc_id"], "left").orderBy("doc_id")
        got = [(r.bm25, r.y or 0.0) for r in rows.select("bm25", "y").collect()]  # one query's candidates
        if not got:
            return _holds(self.spark.range(0), F.lit(True))
        top = max(max(abs(s) for s, _ in got), EPS)
        fit = learn_parameters([s / top for s, _ in got], [y for _, y in got], 0.1, 500, 1e-8)
        steps = list(zip(fit["losses"], fit["losses"][1:], strict=False))
        falls = sum(b <= a + EPS for a, b in steps)
        passed = fit["alpha"] > 0 and fit["losses"][-1] < fit["losses"][0] and falls >= len(steps) * 8 // 10
        return _holds(self.spark.range(len(got)), F.lit(bool(passed)))

    def conjunction_bounds(self) -> DataFrame:
        g = (0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99)
        rows = _grid(self.spark, [(a, b, c) for a in g for b in g for c in g], "a b c")
        a, b, c = F.col("a"), F.col("b"), F.col("c")
        three = X.log_odds_conjunction([a, b, c]) <= X.prob_or([a, b, c]) + EPS
        return _holds(rows, self._bounds([a, b]) & three & (F.abs(X.log_odds_conjunction([a]) - a) <= EPS))

    def base_rate(self) -> DataFrame:
        """A low base rate lowers each probability, one of a half leaves it."""
        if self.packed is not None:
            inside = lambda x: (x >= -EPS) & (x <= 1 + EPS)
            each = self.packed.rates_hold([None, 0.01, 0.5], lambda none, low, half: inside(none) & inside(low) & (low <= none + EPS) & (np.abs(half - none) <= 1e-4))
            return each.agg((F.coalesce(F.sum("good"), F.lit(0)) == F.coalesce(F.sum("tested"), F.lit(0))).alias("passed"), F.coalesce(F.sum("tested"), F.lit(0)).alias("tested"))
        p = self.index.params
        made = [sparse_scores(Index(self.index.docs, Params(p.k1, p.b, p.method, p.alpha, p.beta, rate)), self.queries).select("query_id", "doc_id", F.col("bayes").alias(n)) for n, rate in (("none", None), ("low", 0.01), ("half", 0.5))]
        rows = reduce(lambda x, y: x.join(y, ["query_id", "doc_id"]), made)
        return _holds(rows, _within(F.col("none")) & _within(F.col("low")) & (F.col("low") <= F.col("none") + EPS) & (F.abs(F.col("half") - F.col("none")) <= 1e-4))

    def log_odds(self) -> DataFrame:
        """Agreement amplifies, disagreement cancels, more signals and a larger exponent strengthen, equal weights change nothing."""
        lit = lambda *ps: [F.lit(p) for p in ps]
        f = X.log_odds_conjunction
        return _holds(self.spark.range(1), (f(lit(0.9, 0.9)) > 0.9) & (F.abs(f(lit(0.9, 0.1)) - 0.5) <= 0.15) & (F.abs(f(lit(0.5, 0.5)) - 0.5) <= EPS) & (f(lit(0.8, 0.8, 0.8)) > f(lit(0.8, 0.8))) & (f(lit(0.8, 0.8), 0.8) > f(lit(0.8, 0.8), 0.3)) & (F.abs(f(lit(0.7, 0.8), 0.0, [0.5, 0.5]) - f(lit(0.7, 0.8), 0.0)) <= 1e-6))

    def fusion_primitives(self) -> DataFrame:
        """Double complement, de Morgan's law, and a fusion weight that matters."""
        rows = _grid(self.spark, [(0.3, 0.1), (0.6, 0.5), (0.8, 0.9), (0.1, 0.7)], "a b").withColumn("query_id", F.lit(1))
        a, b = F.col("a"), F.col("b")
        rows = rows.select("a", "b", min_max(X.logit(X.cosine_to_probability(b))).alias("d"), min_max(X.logit(a)).alias("s"))
        rows = rows.withColumn("differ", F.max(F.abs(F.col("d") - F.col("s"))).over(Window.partitionBy()))
        law = F.abs(X.prob_not(X.prob_and([a, b])) - X.prob_or([X.prob_not(a), X.prob_not(b)])) <= 1e-8
        return _holds(rows, law & (F.abs(X.prob_not(X.prob_not(a)) - a) <= 1e-8) & (F.col("differ") > 0))

    CHECKS = ("formula_equivalence", "score_range", "monotonicity", "prior_bounds", "idf_properties", "hybrid_quality", "method_comparison", "numeric_stability", "parameter_learning", "conjunction_bounds", "base_rate", "log_odds", "fusion_primitives")

    def run_all(self) -> DataFrame:
        """(number, check, passed, tested), a row for each check. Checks run one after another, since the driver would hold all of their plans else."""
        got = [(i, n, *getattr(self, n)().select("passed", "tested").first()) for i, n in enumerate(self.CHECKS, 1)]
        return self.spark.createDataFrame(got, "number int, check string, passed boolean, tested long")
