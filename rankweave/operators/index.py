"""Index relations: documents' lengths, postings, term and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.analysis import tokenize

#: Distinct query terms up to which postings are filtered by a broadcast of them.
BROADCAST_TERMS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small table may be one file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True)
class Params:
    """Parameters of scoring, with the defaults of the command line."""

    k1: float = 1.2
    b: float = 0.75
    method: str = "robertson"
    alpha: float = 1.0
    beta: float = 0.5
    base_rate: float | None = None
    hybrid_alpha: float = 0.5

    def __post_init__(self) -> None:
        if self.base_rate is not None and not 0.0 < self.base_rate < 1.0:
            raise ValueError("the base rate must lie in (0, 1)")
        if self.method not in ("robertson", "lucene"):
            raise ValueError(f"unknown BM25 method {self.method}")


@dataclass
class Index:
    """docs(doc_id, tokens, doc_len) and what is counted of it; relations are lazy."""

    docs: DataFrame
    params: Params = field(default_factory=Params)
    #: Postings and document frequencies that are stored, where the index has been loaded.
    stored: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def build(cls, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", terms: str | None = None, params: Params | None = None) -> Index:
        """From texts, or from ready ``terms`` where they are not null."""
        tokens = tokenize(F.col(text)) if terms is None else F.coalesce(F.col(terms), tokenize(F.col(text)))
        cols = [c for c in dict.fromkeys([doc_id, text, terms]) if c]
        rows = spread(docs.select(*cols)).select(F.col(doc_id).alias("doc_id"), tokens.alias("tokens"))
        return cls(rows.withColumn("doc_len", F.size("tokens")), params or Params())

    def corpus_stats(self) -> DataFrame:
        """One row: n, avgdl (0 for no documents)."""
        return self.docs.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))

    def postings(self, only: DataFrame | None = None) -> DataFrame:
        """(doc_id, term, doc_len, tf); with ``only``(term), those terms alone, filtered before the shuffle."""
        if self.stored:
            rows = self.stored[0].select("doc_id", "doc_len", "term", "tf")
        else:
            rows = self.docs.select("doc_id", "doc_len", F.explode_outer("tokens").alias("term")).where("term is not null")  # the outer form asks the tokens once
        if only is not None:
            wanted = only.select("term").distinct()
            small = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
            rows = rows.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
        if self.stored:
            return rows.select("doc_id", "term", "doc_len", "tf")
        return rows.groupBy("doc_id", "term").agg(F.first("doc_len").alias("doc_len"), F.count("*").alias("tf"))

    def term_stats(self, postings: DataFrame) -> DataFrame:
        """(term, df) of the terms in ``postings``, which holds all of a term's documents or none."""
        if self.stored:
            return self.stored[1].join(postings.select("term").distinct(), "term", "left_semi")
        return postings.groupBy("term").agg(F.count("*").alias("df"))

    def get(self, doc_id, order: str | None = None) -> DataFrame:
        """The document of an id, at most one row; of several the last by ``order`` (its tokens without one)."""
        rows = self.docs.where(F.col("doc_id") == F.lit(doc_id))
        return rows.orderBy(F.col(order).desc() if order else F.col("tokens").desc()).limit(1)

    def save(self, path: str) -> None:
        """docs, postings and statistics as Parquet, the parameters as JSON; :meth:`load` reads them."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        p = self.postings()
        p.write.mode("overwrite").parquet(f"{path}/postings")
        self.term_stats(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
        row = {"version": 1, **self.params.__dict__}
        spark.createDataFrame([row], "version int, k1 double, b double, method string, alpha double, beta double, base_rate double, hybrid_alpha double").coalesce(1).write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        row = spark.read.schema("version int, k1 double, b double, method string, alpha double, beta double, base_rate double, hybrid_alpha double").json(f"{path}/params").first()
        if row is None or row.version != 1:
            raise ValueError("not an index of version 1")
        got = row.asDict()
        got.pop("version")
        return cls(spark.read.parquet(f"{path}/docs"), Params(**got), (spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")))


def idf(n, df, method: str):
    """Robertson's may be negative; Lucene's is not."""
    odds = (n - df + 0.5) / (df + 0.5)
    return F.log(1.0 + odds) if method == "lucene" else F.log(odds)


def length_norm(ratio, p: Params):
    return 1.0 - p.b + p.b * ratio


def rewritten_term_score(weight, tf, ratio, p: Params):
    """A term's weight times its boost; equal to the standard form, 0 without an occurrence."""
    tf = tf.cast("double")
    boost = tf / (p.k1 * length_norm(ratio, p) + tf) * (1.0 if p.method == "lucene" else p.k1 + 1.0)
    return F.when(tf > 0, weight * boost).otherwise(0.0)


def upper_bound(weight, p: Params):
    """What a term of this weight can add to a score at most; never below 0."""
    return F.greatest(weight, F.lit(0.0)) * (1.0 if p.method == "lucene" else p.k1 + 1.0)


def check_fields(docs: DataFrame, fields: list[str]) -> list[str]:
    """``fields``, if each is named once and no document lacks one (null tokens); else an error that names a document.

    Empty where a field has no token in any document: then there is no multi-field scorer.
    """
    if not fields or len(set(fields)) != len(fields):
        raise ValueError("fields must be a non-empty list without repeats")
    lacks = F.coalesce(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields))
    first = docs.select("doc_id", lacks.alias("f")).where("f is not null").limit(1).collect()
    if first:
        raise ValueError(f'document {first[0].doc_id} lacks field "{first[0].f}"')
    tokens = docs.agg(*(F.sum(F.size(f)).alias(f) for f in fields)).first()
    return list(fields) if all(tokens[f] for f in fields) else []


def n_blocks(n_docs: int, block: int) -> int:
    return -(-n_docs // block)


def block_bounds(blocks: DataFrame, asked: DataFrame, n_docs: int, block: int, *, alpha: float = 1.0, beta: float = 0.0, base_rate: float | None = None, p_max: float = 0.9) -> DataFrame:
    """asked(term, block_id) with max_score (0 where no document of the block has the term) and bayes_bound.

    An unknown term or a block out of range is an error when the rows are computed.
    """
    known = blocks.select("term").distinct().withColumn("known", F.lit(True))
    rows = asked.join(known, "term", "left").join(blocks, ["term", "block_id"], "left")
    wrong = F.when(F.col("known").isNull(), F.concat(F.lit("unknown term "), "term")).when((F.col("block_id") < 0) | (F.col("block_id") >= n_blocks(n_docs, block)), F.concat(F.lit("no block "), F.col("block_id").cast("string")))
    bound = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(F.coalesce("max_score", F.lit(0.0)))
    return rows.select("term", "block_id", bound.alias("max_score")).withColumn("bayes_bound", X.wand_upper_bound(F.col("max_score"), alpha, beta, base_rate, p_max))


def block_max(scores: DataFrame, block: int) -> DataFrame:
    """From (term, doc_ord, score) each term's maximum by block of documents; NaN does not count."""
    value = F.when(~F.isnan("score"), F.col("score"))
    return scores.groupBy("term", F.floor(F.col("doc_ord") / block).cast("long").alias("block_id")).agg(F.max(value).alias("max_score"))
