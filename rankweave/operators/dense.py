"""Cosines of a query set against all documents, block by block, without a row for each pair.

Queries become a matrix; a batch of documents times that matrix gives the cosines of all of its
pairs at once. A task keeps each query's best documents so far and sends those, or it counts the
distances by bins and sends the bins. Query sets above a bound take one pass for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import EPS

#: Queries whose matrix goes to every task at once; cells of a product in memory; rows of best documents held before the rest is dropped.
QUERY_BATCH, CELLS, HELD = 10_000, 1 << 21, 1 << 18
#: Distance bins in a unit of cosine, and cells of counts that a task holds.
BINS, COUNTS = 1 << 12, 1 << 22


def padded(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x = np.asarray(r or [], float)[:dim]
        out[i, : len(x)] = x
    return out


def _vectors(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``dim`` components of each vector, and its norm over all; null, empty and unsound vectors are 0."""
    off, n = col.offsets.to_numpy().astype(np.int64), len(col)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    size = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
    sums = np.zeros(n)
    some = np.flatnonzero(size)
    x = np.zeros((n, dim))
    for length in np.unique(size[some]).tolist():
        at = some[size[some] == length]
        full = flat[off[at][:, None] + np.arange(length)]
        sums[at] = (full * full).sum(1)
        x[at, : min(length, dim)] = full[:, :dim]
    bad = ~np.isfinite(sums)
    x[bad], sums[bad] = 0.0, 0.0
    return x, np.sqrt(sums)


def cosine_pieces(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with the cosines of their documents (columns) to all queries (rows)."""
    qn = np.sqrt((q * q).sum(1))
    unit = q / np.where(qn < EPS, 1.0, qn)[:, None]
    unit[qn < EPS] = 0.0
    step = max(1, CELLS // max(1, len(q)))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            piece = b.slice(lo, step)
            x, norm = _vectors(piece.column("embedding"), q.shape[1])
            x /= np.where(norm < EPS, 1.0, norm)[:, None]
            x[norm < EPS] = 0.0
            yield piece, unit @ x.T


def _best(q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(q), np.iinfo(np.int64).min)
        held: list[pa.Table] = []
        size = 0

        def kept() -> pa.Table:
            t = pa.concat_tables(held)
            t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("level", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
            of = t.column("q").to_numpy()
            first = np.searchsorted(of, np.arange(len(q)))
            rank = np.arange(len(of)) - first[of]
            last = np.flatnonzero(rank == k - 1)
            least[of[last]] = t.column("level").to_numpy()[last]
            return t.filter(pa.array(rank < k))

        for piece, cos in cosine_pieces(batches, q):
            level = np.floor(cos * 1e9 + 0.5).astype(np.int64)  # nine digits decide, then the id
            of, row = np.nonzero(level >= least[:, None])
            if len(of):
                held.append(pa.table({"q": of, "level": level[of, row], "cos": cos[of, row], "doc_id": piece.column("doc_id").take(pa.array(row))}))
                size += len(of)
            if size > max(HELD, 4 * k * len(q)):
                held = [kept()]
                size = held[0].num_rows
        if held:
            yield from kept().select(["q", "doc_id", "cos"]).combine_chunks().to_batches()

    return run


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of the queries with a vector, ``most`` at a time about."""
    rows = queries.where("embedding is not null").select("query_id", "embedding")
    n = rows.count()
    parts = max(1, -(-n // most))
    for i in range(parts if n else 0):
        got = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).collect()  # one block
        for lo in range(0, len(got), most):
            some = got[lo : lo + most]
            yield [r.query_id for r in some], padded([r.embedding for r in some], max((len(r.embedding) for r in some), default=0))


def passes(docs: DataFrame, queries: DataFrame, most: int, fn: Callable, schema: str, more: Sequence[str] = ()) -> DataFrame:
    """``fn`` of each query block's ids and matrix over all documents, their vectors and columns ``more``; ``q`` of the schema becomes the query's id."""
    spark, kind = docs.sparkSession, queries.select("query_id").schema[0].dataType.simpleString()
    rows = docs.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), *more)
    out, rest = None, [x.split()[0] for x in schema.split(", ")[1:]]
    for ids, matrix in _blocks(queries, most):
        got = rows.mapInArrow(fn(ids, matrix), schema)
        names = spark.createDataFrame(list(enumerate(ids)), f"q long, query_id {kind}").coalesce(1)
        one = got.join(F.broadcast(names), "q").select("query_id", *rest)  # as many names as queries in the block
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], f"query_id {kind}, {schema.split(', ', 1)[1]}") if out is None else out


def best_documents(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, cos): of each task its ``k`` best documents by query, by nine digits of the cosine and the
    id, so the best ``k`` of all are among them.

    docs(doc_id, embedding), queries(query_id, embedding). A null query vector leaves the query out; empty or
    zero vectors, and documents' with null or non-finite components, have cosine 0; of vectors of different
    length the shorter counts as if 0 followed.
    """
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return passes(docs, queries, QUERY_BATCH, lambda _, q: _best(q, k), f"q long, doc_id {kind}, cos double")


def _every(q: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, cos in cosine_pieces(batches, q):
            ids = piece.column("doc_id").take(pa.array(np.tile(np.arange(piece.num_rows), len(q))))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), piece.num_rows)), ids, pa.array(cos.ravel())], names=["q", "doc_id", "cos"])

    return run


def cosines(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, cos) of every pair, a row each: for a query or a few that need all of their scores."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return passes(docs, queries, QUERY_BATCH, lambda _, q: _every(q), f"q long, doc_id {kind}, cos double")


def _counted(q: np.ndarray):
    width = 2 * BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d1, d2 = (np.zeros(len(q) * width) for _ in range(3))
        low, high = np.full(len(q) * width, np.inf), np.full(len(q) * width, -np.inf)
        for _, cos in cosine_pieces(batches, q):
            far = np.maximum(0.0, 1.0 - np.clip(cos, -1.0, 1.0)).ravel()
            at = np.floor(far * BINS).astype(np.int64) + np.repeat(np.arange(len(q)) * width, cos.shape[1])
            for total, w in ((n, None), (d1, far), (d2, far * far)):
                total += np.bincount(at, weights=w, minlength=len(total))
            np.minimum.at(low, at, far)
            np.maximum.at(high, at, far)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some // width), pa.array(some % width), *(pa.array(x[some]) for x in (n, d1, d2, low, high))], names=["q", "bin", "n", "d1", "d2", "low", "high"])

    return run


def distance_bins(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, bin, n, d1, d2, low, high): number, sum, sum of squares and range of all documents' cosine
    distances in each of ``BINS`` bins a unit; 2 * BINS + 1 rows a query at most."""
    rows = passes(docs, queries, max(1, COUNTS // (2 * BINS + 1)), lambda _, q: _counted(q), "q long, bin long, n double, d1 double, d2 double, low double, high double")
    return rows.groupBy("query_id", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "d1", "d2")), F.min("low").alias("low"), F.max("high").alias("high"))
