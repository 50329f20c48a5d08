"""Training sets of fusion models: features of queries, judged pairs with drawn negatives, splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base_rate import first_shuffled, folds, shuffled, split_queries
from .scoring import top_k

BASIC, RICH = ("f0", "f1", "f2"), ("f0", "f1", "f2", "f3", "f4", "f5", "f6")


def query_features(ids: DataFrame, queries: DataFrame, sparse: DataFrame | None, near: DataFrame, candidates: DataFrame, n_docs: int, depth: int = 100, extents: DataFrame | None = None) -> DataFrame:
    """(query_id, f0..f6), each over all documents.

    f0 length, f1 share of documents with a positive score, f2 largest score, f3 and f4 mean and
    deviation of the ten best cosines, f5 the best of them, f6 overlap of the ``depth`` best by
    either signal; lengths and largest values as log(1 + x). ``candidates`` holds at least those,
    ``near``(query_id, doc_id, cos) at least the ten best cosines. ``extents``(query_id, n, most), the number of
    positive scores and the largest, stands for ``sparse``.
    """
    length = queries.groupBy("query_id").agg(F.log1p(F.sum("qtf").cast("double")).alias("f0"))
    seen = sparse.where("bm25 > 0").groupBy("query_id").agg(F.count("*").alias("n"), F.max("bm25").alias("most")) if extents is None else extents
    hits = seen.select("query_id", (F.col("n") / float(max(n_docs, 1))).alias("f1"), F.log1p("most").alias("f2"))
    near = top_k(near, 10, "cos").groupBy("query_id").agg(F.avg("cos").alias("f3"), F.stddev_pop("cos").alias("f4"), F.log1p(F.greatest(F.max("cos"), F.lit(0.0))).alias("f5"))
    in_s, in_d = F.coalesce(F.col("rank_sparse") <= depth, F.lit(False)), F.coalesce(F.col("rank_dense") <= depth, F.lit(False))
    both, either = F.sum((in_s & in_d).cast("double")), F.sum((in_s | in_d).cast("double"))
    shared = candidates.groupBy("query_id").agg((both / F.nullif(either, F.lit(0.0))).alias("f6"))
    out = ids.select("query_id").distinct()
    for part in (length, hits, near, shared):
        out = out.join(part, "query_id", "left")
    return out.select("query_id", *(F.coalesce(f, F.lit(0.0)).alias(f) for f in RICH))


def drawn(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """``candidates``, each model's, with ``label``: all judged rows and as many unjudged ones as there are positive.

    candidates(query_id, doc_id, relevance, ...): a null relevance is unjudged. order(model,
    query_id, seed) names each model's queries and the seed of each draw. A query's candidates
    are bounded by the candidate depth and drawn in one task.
    """
    rows = candidates.join(F.broadcast(order), "query_id")  # at most a row for each model and training query

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("doc_id", kind="stable").reset_index(drop=True)
        judged, rest = p[p.relevance.notna()], p[p.relevance.isna()]
        n = min(int((judged.relevance > 0).sum()), len(rest))
        got = pd.concat([judged, rest.iloc[shuffled(len(rest), int(p.seed.iloc[0]))[:n]]])
        return got.assign(label=(got.relevance.fillna(0.0) > 0).astype(float)).drop(columns="seed")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "seed")
    return rows.groupBy("model", "query_id").applyInPandas(one, f"{fields}, label double")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, at): each document's place by id, from 0, without sorting in one task."""
    rows = docs.select("doc_id").orderBy("doc_id").select("doc_id", F.monotonically_increasing_id().alias("mark")).persist()
    part, nth = F.shiftright("mark", 33), F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    first = docs.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts[:-1], strict=True)], "part long, start long")
    return rows.withColumn("part", part).join(F.broadcast(first), "part").select("doc_id", (nth + F.col("start")).alias("at"))


def drawn_documents(docs: DataFrame, n_docs: int, k: int, seed: int) -> list:
    """The ids of the first ``k`` documents of the seeded shuffle of all, which stand by id; the caller's sample."""
    drawn = docs.sparkSession.createDataFrame([(int(i), place) for place, i in enumerate(first_shuffled(n_docs, k, seed))], "at long, place int")
    return [r.doc_id for r in numbered(docs).join(F.broadcast(drawn), "at").orderBy("place").select("doc_id").collect()]


def drawn_numbers(judged: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, at): of each query as many documents without a judgment, drawn from all, as are positive.

    judged(query_id, seed, at, relevance). A task shuffles numbers only, one query at a time.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(p["at"].to_numpy())
        rest = n_docs - len(known)
        n = min(int((p.relevance > 0).sum()), rest)
        nth = first_shuffled(rest, n, int(p.seed.iloc[0]))
        at = nth + np.searchsorted(known - np.arange(len(known)), nth, "right")  # past the judged ones before it
        return pd.DataFrame({"query_id": p.query_id.iloc[0], "at": at})

    kind = judged.select("query_id").schema[0].dataType.simpleString()
    return judged.select("query_id", "seed", "at", "relevance").groupBy("query_id").applyInPandas(one, f"query_id {kind}, at long")


def trainable(labels: Sequence[float], least: int = 10) -> bool:
    """Enough pairs, of both classes."""
    y = np.asarray(labels)
    return len(y) >= least and 0 < int((y > 0).sum()) < len(y)


def protocol(ids: list, kind: str, ratio: float = 0.5, seed: int = 42, k: int = 5, given: tuple[list, list] | None = None) -> tuple[list[tuple], list[tuple]]:
    """(model, query_id, seed) of all training queries and (query_id, model) of all that are ranked.

    ``all`` trains and ranks with every query, ``split`` parts them (or takes the parts ``given``), ``cv`` ranks each of ``k``
    folds with a model of the others.
    """
    if kind == "all":
        return [(0, q, i + 1) for i, q in enumerate(ids)], [(q, 0) for q in ids]
    if kind == "split":
        train, rest = given or split_queries(ids, ratio, seed)
        return [(0, q, seed + i + 1) for i, q in enumerate(train)], [(q, 0) for q in rest]
    if kind != "cv":
        raise ValueError(f"unknown protocol {kind}")
    if len(ids) < 2:
        return [], []
    parts, order = folds(ids, k, seed), [ids[i] for i in shuffled(len(ids), seed)]
    train = [(m, q, seed + m + 1 + i + 1) for m, part in enumerate(parts) for i, q in enumerate(x for x in order if x not in set(part))]
    return train, [(q, m) for m, part in enumerate(parts) for q in part]


def explicit_split(ids: list, train: list | None, rest: list | None) -> tuple[list, list]:
    """Given training and evaluation ids, in their order; one list alone, a repeated or an unknown id is an error."""
    if train is None or rest is None:
        raise ValueError("give both training and evaluation ids")
    both, known = [*train, *rest], set(ids)
    if len(set(both)) != len(both):
        raise ValueError("an id is given twice")
    unknown = [i for i in both if i not in known]
    if unknown:
        raise ValueError(f"unknown query ids: {unknown[:5]}")
    return list(train), list(rest)


def numpy_split(ids: list, ratio: float, seed: int) -> tuple[list, list]:
    """numpy's own shuffle, and the training share rounded down."""
    order = list(ids)
    np.random.default_rng(seed).shuffle(order)
    n = math.floor(len(order) * ratio)
    return order[:n], order[n:]
