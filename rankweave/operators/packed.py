"""Documents as packed arrays of the terms that queries ask for, scored in batches without a row for each match.

Texts are read and tokenised once: a document becomes the numbers of its query terms and their frequencies,
and these arrays are kept. A task adds up the scores of a batch of documents and all queries in one table of
numbers and sends each query's best documents, so neither matches nor sums are shuffled. The queries' terms
go to every task; a query set above ``ASKED`` rows is left to the joins of :mod:`.scoring`, or dealt in :func:`groups`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index, Params
from .learners import composite_prior, safe, sigmoid

#: Rows of (query, term) that go to every task; cells of scores, and matches, that a task holds at once; rows of best
#: documents held before the rest is dropped; documents tokenised at once.
ASKED, CELLS, MATCHES, HELD, ROWS = 500_000, 1 << 20, 1 << 21, 1 << 18, 500


def groups(queries: DataFrame, n: int = 1, g: int = 0) -> Iterator[DataFrame]:
    """queries(query_id, term, qtf) in groups of at most ``ASKED`` rows, or of one query: those with more are halved by a hash of the id."""
    some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == g)
    rows = some.limit(ASKED + 1).count()
    if 0 < rows <= ASKED or (rows and some.select("query_id").distinct().limit(2).count() == 1):
        yield some
    elif rows:
        yield from groups(queries, 2 * n, g)
        yield from groups(queries, 2 * n, g + n)


@dataclass(frozen=True)
class Asked:
    """Queries by number, and of each term (by number too) the queries that ask for it."""

    ids: list
    kind: str
    terms: list[str]
    start: np.ndarray
    query: np.ndarray
    qtf: np.ndarray

    @classmethod
    def of(cls, queries: DataFrame) -> Asked | None:
        """From (query_id, term, qtf); none above ``ASKED`` rows."""
        rows = queries.select("query_id", "term", "qtf").limit(ASKED + 1).collect()
        if len(rows) > ASKED:
            return None
        ids, terms = sorted({r.query_id for r in rows}), sorted({r.term for r in rows})
        at, number = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
        rows.sort(key=lambda r: (r.term, r.query_id))
        term = np.array([number[r.term] for r in rows], np.int64)
        start = np.searchsorted(term, np.arange(len(terms) + 1))
        return cls(ids, queries.schema["query_id"].dataType.simpleString(), terms, start, np.array([at[r.query_id] for r in rows], np.int64), np.array([r.qtf for r in rows], float))

    def only(self, ids: list) -> Asked:
        """Its queries among ``ids``; all numbers stay."""
        kept = np.isin(self.query, np.flatnonzero([q in set(ids) for q in self.ids]))
        before = np.concatenate([[0], np.cumsum(kept)])
        return replace(self, start=before[self.start], query=self.query[kept], qtf=self.qtf[kept])

    def names(self, spark) -> DataFrame:
        """(q, query_id)"""
        return spark.createDataFrame(list(enumerate(self.ids)), f"q long, query_id {self.kind}").coalesce(1)


def _pack(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, size = pa.array(terms, pa.string()), max(1, len(terms))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                col = b.column("tokens")
                off = col.offsets.to_numpy().astype(np.int64)
                n = np.diff(off)
                at = pc.fill_null(pc.index_in(col.values.slice(off[0], off[-1] - off[0]), value_set=values), -1).to_numpy().astype(np.int64)
                key = np.repeat(np.arange(len(n)) * size, n) + at
                key, tf = np.unique(key[at >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * size), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % size, tf))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "doc_len", "term", "tf"])

    return run


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists without nulls."""
    off = col.offsets.to_numpy().astype(np.int64)
    return np.diff(off), col.values.slice(off[0], off[-1] - off[0]).to_numpy()


@dataclass(frozen=True)
class Model:
    """What scores a posting: parameters and corpus statistics, the terms' document frequencies by number."""

    asked: Asked
    params: Params
    n: float
    avgdl: float
    df: np.ndarray

    def postings(self, doc_len: np.ndarray, term: pa.Array, tf: pa.Array) -> tuple[np.ndarray, ...]:
        """(row, term, tf, ratio) of packed documents; a document of several rows counts a term once."""
        n, t = _flat(term)
        row, size, tf = np.repeat(np.arange(len(n)), n), max(1, len(self.df)), _flat(tf)[1].astype(float)
        key = row * size + t
        if (np.diff(key) <= 0).any():
            key, at = np.unique(key, return_inverse=True)
            tf = np.bincount(at, weights=tf)
            row, t = key // size, key % size
        ratio = doc_len / self.avgdl if self.avgdl > 0 else np.ones(len(doc_len))
        return row, t, tf, ratio[row]

    def raw(self, t: np.ndarray, tf: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """BM25 of a term in a document."""
        p = self.params
        odds = (self.n - self.df + 0.5) / (self.df + 0.5)
        weight = np.log(1.0 + odds) if p.method == "lucene" else np.log(odds)
        return weight[t] * (tf / (p.k1 * (1.0 - p.b + p.b * ratio) + tf)) * (1.0 if p.method == "lucene" else p.k1 + 1.0)

    def posterior(self, raw: np.ndarray, prior: np.ndarray | float, rate: float | None) -> np.ndarray:
        like, prior = safe(sigmoid(self.params.alpha * (raw - self.params.beta))), safe(prior)
        post = like * prior / (like * prior + (1.0 - like) * (1.0 - prior))
        return post if rate is None else post * rate / (post * rate + (1.0 - post) * (1.0 - rate))

    def prior(self, tf: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        if self.avgdl < 1.0:
            return np.clip(0.7 * (0.2 + 0.7 * np.minimum(tf / 10.0, 1.0)) + 0.15, 0.1, 0.9)
        return composite_prior(tf, ratio)

    def miss(self, raw: np.ndarray, tf: np.ndarray, ratio: np.ndarray, rate: float | None) -> np.ndarray:
        """The logarithm of what a term's posterior leaves to one; 0 for a raw score of 0."""
        return np.where(raw != 0, np.log(1.0 - safe(self.posterior(raw, self.prior(tf, ratio), rate))), 0.0)

    def part(self, score: str, t: np.ndarray, tf: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """What a posting adds to a query's sum, for each time that the query has its term."""
        raw = self.raw(t, tf, ratio)
        return raw if score == "bm25" else self.miss(raw, tf, ratio, self.params.base_rate)

    def matches(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting, place in asked.query) of each query that asks for a posting's term."""
        first = self.asked.start[t]
        n = self.asked.start[t + 1] - first
        return np.repeat(np.arange(len(t)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Few enough documents at a time for ``CELLS`` and ``MATCHES``."""
        step = max(1, CELLS // max(1, len(self.asked.ids)))
        each = np.diff(self.asked.start)
        for batch in batches:
            n, t = _flat(batch.column("term"))
            ends = np.concatenate([[0], np.cumsum(each[t])])[np.concatenate([[0], np.cumsum(n)])]
            lo = 0
            while lo < batch.num_rows:
                hi = min(lo + step, max(lo + 1, int(np.searchsorted(ends, ends[lo] + MATCHES, "right")) - 1), batch.num_rows)
                yield batch.slice(lo, hi - lo)
                lo = hi

    def sums(self, row: np.ndarray, t: np.ndarray, parts: list[np.ndarray], n: int, wanted: Callable | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(n documents, queries): the number of matching terms, and each of ``parts`` summed over them; of ``wanted``(row, query) alone, if given."""
        posting, place = self.matches(t)
        if wanted:
            some = wanted(row[posting], self.asked.query[place])
            posting, place = posting[some], place[some]
        q, shape = len(self.asked.ids), (n, len(self.asked.ids))
        cell, w = row[posting] * q + self.asked.query[place], self.asked.qtf[place]
        return np.bincount(cell, minlength=n * q).reshape(shape), [np.bincount(cell, weights=w * p[posting], minlength=n * q).reshape(shape) for p in parts]


class Best:
    """Each query's ``k`` best documents so far, by nine digits of the score and the id."""

    def __init__(self, queries: int, k: int):
        self.k, self.n, self.least = k, queries, np.full(queries, np.iinfo(np.int64).min)
        self.held: list[pa.Table] = []
        self.size = 0

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, ids: pa.Array) -> None:
        """Scores of the documents ``ids[doc]``."""
        level = np.floor(score * 1e9 + 0.5).astype(np.int64)
        some = np.flatnonzero(level >= self.least[q])
        if len(some):
            self.held.append(pa.table({"q": q[some], "level": level[some], "score": score[some], "doc_id": ids.take(pa.array(doc[some]))}))
            self.size += len(some)
        if self.size > max(HELD, 4 * self.k * self.n):
            self.held = [self.kept()]
            self.size = self.held[0].num_rows

    def kept(self) -> pa.Table:
        t = pa.concat_tables(self.held)
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("level", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
        of = t.column("q").to_numpy()
        rank = np.arange(len(of)) - np.searchsorted(of, np.arange(self.n))[of]
        last = np.flatnonzero(rank == self.k - 1)
        self.least[of[last]] = t.column("level").to_numpy()[last]
        return t.filter(pa.array(rank < self.k))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self.kept().select(["q", "doc_id", "score"]).combine_chunks().to_batches()


def _top(m: Model, k: int, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(m.asked.ids), k)
        for b in m.pieces(batches):
            row, t, tf, ratio = m.postings(b.column("doc_len").to_numpy(), b.column("term"), b.column("tf"))
            hit, (total,) = m.sums(row, t, [m.part(score, t, tf, ratio)], b.num_rows)
            doc, q = np.nonzero(hit)
            total = total[doc, q]
            best.add(q, total if score == "bm25" else 1.0 - np.exp(total), doc, b.column("doc_id"))
        yield from best.batches()

    return run


def _pairs(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in m.pieces(batches):
            row, t, tf, ratio = m.postings(b.column("doc_len").to_numpy(), b.column("term"), b.column("tf"))
            raw = m.raw(t, tf, ratio)
            hit, (total, miss) = m.sums(row, t, [raw, m.miss(raw, tf, ratio, m.params.base_rate)], b.num_rows)
            n, q = _flat(b.column("q"))
            doc, relevance = np.repeat(np.arange(len(n)), n), b.column("relevance").values.slice(b.column("relevance").offsets[0].as_py(), len(q))
            of = b.column("doc_len").to_numpy() / m.avgdl if m.avgdl > 0 else np.ones(b.num_rows)
            some = np.flatnonzero(hit[doc, q] > 0)
            at = doc[some], q[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[1]), b.column("doc_id").take(pa.array(at[0])), pa.array(total[at]), pa.array(1.0 - np.exp(miss[at])), pa.array(hit[at].astype(np.int64)), pa.array(of[at[0]]), relevance.take(pa.array(some))],
                names=["q", "doc_id", "bm25", "bayes", "overlap", "ratio", "relevance"],
            )

    return run


def _found(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in m.pieces(batches):
            row, t, _, _ = m.postings(b.column("doc_len").to_numpy(), b.column("term"), b.column("tf"))
            doc, q = np.nonzero(m.sums(row, t, [], b.num_rows)[0])
            yield pa.RecordBatch.from_arrays([pa.array(q), b.column("at").take(pa.array(doc))], names=["q", "at"])

    return run


def _extents(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = np.zeros(len(m.asked.ids), np.int64), np.full(len(m.asked.ids), -np.inf)
        for b in m.pieces(batches):
            row, t, tf, ratio = m.postings(b.column("doc_len").to_numpy(), b.column("term"), b.column("tf"))
            _, (total,) = m.sums(row, t, [m.raw(t, tf, ratio)], b.num_rows)
            n += (total > 0).sum(0)
            most = np.maximum(most, total.max(0))
        q = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n[q]), pa.array(most[q])], names=["q", "n", "most"])

    return run


@dataclass(frozen=True)
class Packed:
    """docs(doc_id, doc_len, term, tf), a row a document, kept; and the model that scores them."""

    docs: DataFrame
    model: Model

    @classmethod
    def of(cls, index: Index, queries: DataFrame) -> Packed | None:
        """None for too many queries: see :meth:`Asked.of`."""
        asked = Asked.of(queries)
        if asked is None:
            return None
        kind = index.docs.schema["doc_id"].dataType.simpleString()
        rows = index.docs.select("doc_id", "tokens").mapInArrow(_pack(asked.terms), f"doc_id {kind}, doc_len long, term array<int>, tf array<int>")
        whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
        docs = rows.groupBy("doc_id").agg(F.first("doc_len").alias("doc_len"), F.count("*").alias("rows"), F.sum("doc_len").alias("total"), whole("term"), whole("tf")).persist(StorageLevel.MEMORY_AND_DISK)
        seen = docs.agg(F.sum("rows").alias("n"), F.sum("total").alias("total")).first()
        df = np.zeros(len(asked.terms))
        for r in docs.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").count().collect():  # a row a query term
            df[r.term] = r["count"]
        return cls(docs, Model(asked, index.params, float(seen.n or 0), (seen.total or 0) / seen.n if seen.n else 0.0, df))

    def _named(self, rows: DataFrame, *rest: str) -> DataFrame:
        return rows.join(F.broadcast(self.model.asked.names(rows.sparkSession)), "q").select("query_id", *rest)

    def _run(self, fn: Callable, schema: str, docs: DataFrame | None = None) -> DataFrame:
        docs = self.docs if docs is None else docs
        return docs.mapInArrow(fn, f"q long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")

    def with_params(self, params: Params) -> Packed:
        return replace(self, model=replace(self.model, params=params))

    def only(self, ids: list) -> Packed:
        """The same documents, for the queries among ``ids``."""
        return replace(self, model=replace(self.model, asked=self.model.asked.only(ids)))

    def top(self, k: int, score: str = "bm25") -> DataFrame:
        """(query_id, doc_id, score): of each task its ``k`` best matches by query, so the best ``k`` of all are among them."""
        return self._named(self._run(_top(self.model, k, score), "score double"), "doc_id", "score")

    def pairs(self, judged: DataFrame) -> DataFrame:
        """(query_id, doc_id, bm25, bayes, overlap, ratio, relevance) of judged(query_id, doc_id, relevance), where the document has a term of the query."""
        numbered = judged.join(F.broadcast(self.model.asked.names(judged.sparkSession)), "query_id").groupBy("doc_id").agg(F.collect_list(F.struct("q", "relevance")).alias("j"))
        rows = self.docs.join(numbered, "doc_id").select("doc_id", "doc_len", "term", "tf", F.col("j.q").alias("q"), F.col("j.relevance").alias("relevance"))
        got = self._run(_pairs(self.model), "bm25 double, bayes double, overlap long, ratio double, relevance double", rows)
        return self._named(got, "doc_id", "bm25", "bayes", "overlap", "ratio", "relevance")

    def found(self, place: DataFrame) -> DataFrame:
        """(query_id, at) of the queries that have a term of a document of place(doc_id, at); few documents, which go to every task."""
        rows = self.docs.join(F.broadcast(place.select("doc_id", F.col("at").cast("long").alias("at"))), "doc_id")
        return self._named(rows.mapInArrow(_found(self.model), "q long, at long"), "at")

    def extents(self) -> DataFrame:
        """(query_id, n, most): the number of documents with a positive BM25 and the largest, of queries that have any."""
        rows = self.docs.mapInArrow(_extents(self.model), "q long, n long, most double")
        return self._named(rows.groupBy("q").agg(F.sum("n").alias("n"), F.max("most").alias("most")), "n", "most")

    def postings(self) -> DataFrame:
        """(doc_id, term, tf, doc_len, avgdl, n, df, asked): a row a document and term, ``asked`` the number of queries with the term."""
        spark, m = self.docs.sparkSession, self.model
        rows = self.docs.select("doc_id", "doc_len", F.explode(F.arrays_zip("term", "tf")).alias("p")).select("doc_id", "doc_len", F.col("p.term").alias("t"), F.col("p.tf").cast("long").alias("tf"))
        if not self.docs.where("rows > 1").isEmpty():
            rows = rows.groupBy("doc_id", "t").agg(F.first("doc_len").alias("doc_len"), F.sum("tf").alias("tf"))
        known = spark.createDataFrame([(i, t, float(d), int(n)) for i, (t, d, n) in enumerate(zip(m.asked.terms, m.df, np.diff(m.asked.start), strict=True))], "t int, term string, df double, asked long")
        stats = F.lit(m.avgdl).alias("avgdl"), F.lit(m.n).alias("n")
        return rows.join(F.broadcast(known.coalesce(1)), "t").where("asked > 0").select("doc_id", "term", "tf", "doc_len", *stats, "df", "asked")

    def rates_hold(self, rates: list[float | None], condition: Callable[..., np.ndarray]) -> DataFrame:
        """(good, tested): on how many matches of a query and a document ``condition`` holds of their scores at each base rate, and of how many; a row a task."""
        m = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            good = tested = 0
            for b in m.pieces(batches):
                row, t, tf, ratio = m.postings(b.column("doc_len").to_numpy(), b.column("term"), b.column("tf"))
                raw = m.raw(t, tf, ratio)
                hit, totals = m.sums(row, t, [m.miss(raw, tf, ratio, r) for r in rates], b.num_rows)
                some = hit > 0
                tested += int(some.sum())
                good += int(condition(*(1.0 - np.exp(x[some]) for x in totals)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([good], pa.int64()), pa.array([tested], pa.int64())], names=["good", "tested"])

        return self.docs.mapInArrow(run, "good long, tested long")
