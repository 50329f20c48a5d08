"""Top-k search that reads only the blocks of documents whose bound reaches the query's threshold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .index import BROADCAST_TERMS, Index, Params
from .learners import safe
from .packed import CELLS, MATCHES, Best, Model, Packed
from .scoring import bm25_of, posterior_of, top_k

#: Documents to a block; blocks searched for the threshold; hash groups of a length class, which number the
#: documents independently. Small blocks have tight bounds and a longer table of them.
BLOCK, FIRST, GROUPS = 8, 32, 256
#: What a bound may miss by rounding, and what scores are rounded by when ranked.
SLACK = 1e-8
#: Best rows that all tasks of a packed search send, as long as each core has a task.
SENT = 1 << 23


def ordinals(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_len, ord): documents numbered from 0 without gaps, those of like length together.

    Numbers are given inside groups (an eighth of a doubling of length by a hash of the id) and moved by the
    number of documents in the groups before, a table of some ten thousand rows; so no task
    sorts the documents, and every evaluation numbers them alike. Repeated ids share their first number.
    """
    length = F.floor(8 * F.log2(1 + F.col("doc_len"))).cast("int")
    rows = docs.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    rows = rows.withColumns({"g": length, "h": F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).cast("int")})
    size = rows.groupBy("g", "h").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("g", "h").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select("g", "h", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("g", "h").orderBy("doc_id"))
    return rows.withColumn("at", inside).join(F.broadcast(size), ["g", "h"]).select("doc_id", "doc_len", (F.col("before") + F.col("at") - 1).alias("ord"))


def block_bounds_of(postings: DataFrame) -> DataFrame:
    """(term, block_id, max_score, n) of scored postings."""
    return postings.groupBy("term", "block_id").agg(F.max("raw").alias("max_score"), F.count("*").alias("n"))


@dataclass
class BlockIndex:
    """postings(term, block_id, doc_id, tf, ratio, avgdl, raw) and blocks(term, block_id, max_score, n)."""

    postings: DataFrame
    blocks: DataFrame
    params: Params

    @classmethod
    def build(cls, index: Index, block: int = BLOCK) -> BlockIndex:
        """All terms of ``index`` with their scores, lazily; :meth:`save` stores them."""
        p, stats = index.params, F.broadcast(index.corpus_stats())  # one row
        rows = index.postings()
        places = ordinals(index.docs).select("doc_id", F.floor(F.col("ord") / block).cast("long").alias("block_id"))
        rows = rows.join(places, "doc_id").join(index.term_stats(rows), "term").crossJoin(stats)
        ratio, raw = bm25_of(p)
        scored = rows.select("term", "block_id", "doc_id", "tf", ratio.alias("ratio"), "avgdl", raw.alias("raw"))
        return cls(scored, block_bounds_of(scored), p)

    def save(self, path: str) -> BlockIndex:
        """Postings dealt and sorted by term and block, so that a frequent term is in many files and a scan
        passes over row groups without a wanted term; the bounds beside them. Returns the stored index."""
        spark = self.postings.sparkSession
        order = ["term", "block_id"]
        self.postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/block_postings")
        postings = spark.read.parquet(f"{path}/block_postings")
        block_bounds_of(postings).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/block_bounds")
        return self.load(spark, path, self.params)

    @classmethod
    def load(cls, spark, path: str, params: Params) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/block_postings"), spark.read.parquet(f"{path}/block_bounds"), params)

    # --- search ----------------------------------------------------------------------------------

    def _bound(self, score: str) -> Column:
        """Of a query's score in a block, from the largest score of each of its terms there.

        The likelihood rises with the score (for this, alpha must not be negative) and no prior is above 0.9.
        """
        if score == "bm25":
            return F.sum(F.col("qtf") * F.greatest("max_score", F.lit(0.0)))
        if self.params.alpha < 0:
            raise ValueError("a negative alpha has no bound by block")
        most = X.wand_upper_bound(F.col("max_score"), self.params.alpha, self.params.beta, self.params.base_rate)
        return 1.0 - F.exp(F.sum(F.col("qtf") * F.log(1.0 - X.safe_prob(most))))

    def bounds(self, queries: DataFrame, score: str = "bm25") -> DataFrame:
        """(query_id, block_id, bound, n): the blocks that hold a term of queries(query_id, term, qtf), n postings of them."""
        return self.blocks.join(queries, "term").groupBy("query_id", "block_id").agg(self._bound(score).alias("bound"), F.sum("n").alias("n"))

    def scores(self, queries: DataFrame, wanted: DataFrame, score: str = "bm25") -> DataFrame:
        """(query_id, doc_id, score) of every document with a match in wanted(query_id, block_id).

        A document lies in one block, so its sum is whole. The join is by term and block: a frequent
        term is dealt by its blocks.
        """
        asked = wanted.select("query_id", "block_id").join(queries, "query_id").join(self.blocks.select("term", "block_id"), ["term", "block_id"])
        rows = self.postings.join(asked, ["term", "block_id"])
        if score == "bm25":
            return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("raw")).alias("score"))
        miss = F.when(F.col("raw") != 0, F.col("qtf") * F.log(1.0 - X.safe_prob(posterior_of(self.params)))).otherwise(0.0)
        return rows.groupBy("query_id", "doc_id").agg((1.0 - F.exp(F.sum(miss))).alias("score"))

    def kept(self, queries: DataFrame, k: int, score: str = "bm25", first: int = FIRST) -> DataFrame:
        """``bounds`` with ``threshold`` and ``kept``: the blocks that may hold one of the best ``k``.

        The ``first`` blocks of the highest bound are searched; the k-th best score in them is the
        threshold (null, and all blocks kept, where they hold fewer than k matches).
        """
        bounds = self.bounds(queries, score)
        best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block_id")
        ahead = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first)
        reached = top_k(self.scores(queries, ahead, score), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
        return bounds.join(reached, "query_id", "left").withColumn("kept", F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - SLACK))

    def search(self, queries: DataFrame, k: int, score: str = "bm25", first: int = FIRST) -> DataFrame:
        """(query_id, doc_id, score, rank): the best ``k`` matches by ``bm25`` or ``bayes``, equal to a full search.

        A query without a matching term has no rows; repeated terms count as often as ``qtf`` says.
        """
        if score not in ("bm25", "bayes"):
            raise ValueError(f"no block bound for {score}")
        return top_k(self.scores(queries, self.kept(queries, k, score, first).where("kept"), score), k)

    def read_share(self, queries: DataFrame, k: int, score: str = "bm25", first: int = FIRST) -> DataFrame:
        """(query_id, blocks, blocks_kept, postings, postings_kept), from the bounds alone."""
        rows = self.kept(queries, k, score, first)
        of = lambda x: F.sum(F.when(F.col("kept"), x).otherwise(0))
        return rows.groupBy("query_id").agg(F.count("*").alias("blocks"), of(F.lit(1)).alias("blocks_kept"), F.sum("n").alias("postings"), of(F.col("n")).alias("postings_kept"))


# --- search of packed blocks ---------------------------------------------------------------------


def _pieces(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray]]:
    """Few enough blocks at a time for a task's tables: (blocks, their documents, each document's place in blocks)."""
    each, cells = np.diff(m.asked.start), max(1, CELLS // max(1, len(m.asked.ids)))
    for batch in batches:
        held = batch.column("docs")
        off = held.offsets.to_numpy().astype(np.int64)
        inner = held.values.slice(off[0], off[-1] - off[0])
        docs = pa.RecordBatch.from_arrays(inner.flatten(), names=[f.name for f in inner.type])
        off -= off[0]
        terms = docs.column("term")
        at = terms.offsets.to_numpy().astype(np.int64)
        matches = np.concatenate([[0], np.cumsum(each[terms.values.slice(at[0], at[-1] - at[0]).to_numpy()])])[(at - at[0])[off]]
        lo = 0
        while lo < batch.num_rows:
            hi = min(int(np.searchsorted(x, x[lo] + most, "right")) - 1 for x, most in ((off, cells), (matches, MATCHES)))
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), docs.slice(off[lo], off[hi] - off[lo]), np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
            lo = hi


def _block_bounds(m: Model, score: str, block: np.ndarray, t: np.ndarray, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n blocks, queries): whether a block has a term of a query, and the bound of its scores."""
    size = max(1, len(m.df))
    key = block * size + t
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    most = np.maximum.reduceat(raw[order], first) if len(first) else raw
    part = np.maximum(most, 0.0) if score == "bm25" else np.log(1.0 - safe(m.posterior(most, 0.9, m.params.base_rate)))
    hit, (total,) = m.sums(key // size, key % size, [part], n)
    return hit > 0, total if score == "bm25" else 1.0 - np.exp(total)


def _search(m: Model, score: str, k: int, threshold: np.ndarray | None = None, ahead: bool = False):
    """A task's ``k`` best documents by query in the wanted blocks: those whose bound reaches the query's ``threshold``, or
    those that the rows name (``q``); or (``ahead``) its ``k`` best blocks by their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(m.asked.ids), k)
        for blocks, docs, block in _pieces(m, batches):
            row, t, tf, ratio = m.postings(docs.column("doc_len").to_numpy(), docs.column("term"), docs.column("tf"))
            if ahead or threshold is not None:
                hit, bound = _block_bounds(m, score, block[row], t, m.raw(t, tf, ratio), blocks.num_rows)
            if ahead:
                at, q = np.nonzero(hit)
                best.add(q, bound[at, q], at, blocks.column("block_id"))
                continue
            if threshold is None:
                off = blocks.column("q").offsets.to_numpy().astype(np.int64)
                wanted = np.zeros((blocks.num_rows, len(m.asked.ids)), bool)
                wanted[np.repeat(np.arange(blocks.num_rows), np.diff(off)), blocks.column("q").values.slice(off[0], off[-1] - off[0]).to_numpy()] = True
            else:
                wanted = hit & (bound >= threshold - SLACK)
            some = wanted.any(1)[block[row]]  # postings of blocks that no query wants are not looked at
            row, t, tf, ratio = row[some], t[some], tf[some], ratio[some]
            hit, (total,) = m.sums(row, t, [m.part(score, t, tf, ratio)], docs.num_rows, lambda row, q: wanted[block[row], q])  # noqa: B023
            doc, q = np.nonzero(hit)
            total = total[doc, q]
            best.add(q, total if score == "bm25" else 1.0 - np.exp(total), doc, docs.column("doc_id"))
        yield from best.batches()

    return run


@dataclass(frozen=True)
class PackedBlocks:
    """blocks(block_id, docs): a row a block, kept, with the query terms of its documents.

    Bounds, thresholds and scores of a block are all computed from its row: nothing that has a row for each term,
    query or match of a block is stored or shuffled.
    """

    blocks: DataFrame
    packed: Packed

    @classmethod
    def of(cls, packed: Packed, block: int = BLOCK) -> PackedBlocks:
        places = ordinals(packed.docs).select("doc_id", F.floor(F.col("ord") / block).cast("long").alias("block_id"))
        rows = packed.docs.where(F.size("term") > 0).join(places, "doc_id")
        return cls(rows.groupBy("block_id").agg(F.collect_list(F.struct("doc_id", "doc_len", "term", "tf")).alias("docs")).persist(StorageLevel.MEMORY_AND_DISK), packed)

    def release(self) -> None:
        """What is kept of the documents goes."""
        self.blocks.unpersist()
        self.packed.docs.unpersist()

    def _few(self, rows: DataFrame, k: int) -> DataFrame:
        """``rows`` in so few tasks that the best ``k`` by query of each are ``SENT`` rows in all."""
        return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, SENT // max(1, k * len(self.packed.model.asked.ids))))

    def _kind(self) -> str:
        return self.packed.docs.schema["doc_id"].dataType.simpleString()

    def thresholds(self, k: int, score: str = "bm25", first: int = FIRST) -> np.ndarray:
        """Of each query by number the k-th best score in its ``first`` blocks of the highest bound; below all scores where they hold fewer."""
        m = self.packed.model
        bounds = self._few(self.blocks, first).mapInArrow(_search(m, score, first, ahead=True), "q long, doc_id long, score double")
        best = Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id")
        ahead = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first).groupBy(F.col("doc_id").alias("block_id")).agg(F.collect_list("q").alias("q"))
        ahead = F.broadcast(ahead) if first * len(m.asked.ids) <= BROADCAST_TERMS else ahead
        found = self._few(self.blocks.join(ahead, "block_id"), k).mapInArrow(_search(m, score, k), f"q long, doc_id {self._kind()}, score double")
        out = np.full(len(m.asked.ids), -np.inf)
        for r in top_k(found.withColumnRenamed("q", "query_id"), k).where(F.col("rank") == k).select("query_id", "score").collect():  # a row a query
            out[r.query_id] = r.score
        return out

    def search(self, k: int, score: str = "bm25", first: int = FIRST) -> DataFrame:
        """(query_id, doc_id, score, rank), as :meth:`BlockIndex.search`."""
        if score not in ("bm25", "bayes"):
            raise ValueError(f"no block bound for {score}")
        m = self.packed.model
        if score == "bayes" and m.params.alpha < 0:
            raise ValueError("a negative alpha has no bound by block")
        found = self._few(self.blocks, k).mapInArrow(_search(m, score, k, self.thresholds(k, score, first)), f"q long, doc_id {self._kind()}, score double")
        best = top_k(found.withColumnRenamed("q", "query_id"), k).withColumnRenamed("query_id", "q")
        return best.join(F.broadcast(m.asked.names(found.sparkSession)), "q").select("query_id", "doc_id", "score", "rank")
