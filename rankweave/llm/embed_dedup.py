"""Near-duplicate vectors: random-hyperplane hashing, exact cosines, connected components.

Equal vectors of a label are one from the start. Each of several tables hashes the rest by the
signs of ``bits`` random projections; vectors with equal label and signs share a bucket. A
bucket is one task's work up to ``block`` vectors; a larger one is dealt into blocks and each
pair of blocks is a unit of its own, so no pair is lost and no task grows with a bucket. Every
pair is compared once, in the first table where its signs agree, by cosine in double precision.

Pairs are not written out: a unit returns how many links each vector has in it, and a forest
that connects what is linked, which is no longer than its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import least_labels, linked_classes
from .textcore import apart, fixed_binary, groups, mix, partitions, seeds, stored, tidy

THRESHOLD = 0.98
BITS = 12
RECALL = 0.999999
BLOCK = 1024
_U = np.uint64


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables with which a pair at the threshold shares a bucket with probability ``recall``."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def hyperplanes(dim: int, n: int) -> np.ndarray:
    """``n`` standard normal directions, the same in every task."""
    u = (mix(np.arange(dim * n * 2, dtype=_U) + seeds(1, 17)[0]) >> _U(11)).astype(float) / 2.0**53
    u1, u2 = u.reshape(2, dim, n)
    return np.sqrt(-2 * np.log(1 - u1)) * np.cos(2 * np.pi * u2)


def _sign(tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            v = b.column("v")
            off = v.offsets.to_numpy()
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.diff(off)
            parts: list = [b""] * len(v)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, tables * bits)
                for some in np.array_split(rows, max(1, len(rows) // 2000)):
                    x = flat[off[some][:, None] + np.arange(dim)]
                    signs = (x @ planes[dim] > 0).reshape(len(some), tables, bits) @ place
                    for i, s in zip(some.tolist(), signs.astype(np.uint32), strict=True):
                        parts[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "copies", "v")), pa.array(parts, pa.binary())], names=["id", "label", "copies", "v", "signs"])

    return run


_LINKS = "id long, n long, root long"


def _compare(threshold: float, tables: int):
    """Links within a unit; ``side`` is 0 or 1 where the unit is a pair of different blocks, else null."""

    def unit(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, copies, table = (t.column(c).to_numpy() for c in ("id", "copies", "table"))
        signs = fixed_binary(t.column("signs"), np.uint32, tables)
        v = t.column("v").combine_chunks()
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)[v.offsets.to_numpy()[0] :].reshape(len(ids), -1)
        side = t.column("side").to_numpy(zero_copy_only=False).astype(float)
        norm = np.sqrt((x * x).sum(1))
        cos = (x @ x.T) / (norm[:, None] * norm[None, :])
        close = np.abs(cos - threshold) < 1e-12
        for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):  # one way of summing decides at the threshold
            cos[i, j] = cos[j, i] = float(np.dot(x[i], x[j]) / (norm[i] * norm[j]))
        linked = cos >= threshold
        np.fill_diagonal(linked, False)
        for k in range(int(table[0])):
            if not linked.any():
                return
            linked &= signs[:, k][:, None] != signs[:, k][None, :]
        if not np.isnan(side).all():
            linked &= side[:, None] != side[None, :]
        n = linked @ copies
        low = least_labels(linked)
        some = np.flatnonzero(n)
        if len(some):
            yield ids[some], n[some], ids[low[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "unit"):
            if t.num_rows > 1:
                for ids, n, root in unit(t):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(root)], names=["id", "n", "root"])

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", threshold: float = THRESHOLD, bits: int = BITS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine is ``threshold`` or
    more. A vector that is null, empty or zero, or has null or non-finite components, links
    with nothing, nor do vectors of different length. Repeated ids are rows of their own that
    count each, and share a component id. Without ``label`` all rows are compared.
    """
    spark = vectors.sparkSession
    tables = tables_for(threshold, bits, recall)
    v = F.col(vector).cast("array<double>")
    fit = F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), (F.lit(0) if label is None else F.col(label)).cast("long").alias("label"), F.when(F.coalesce(fit, F.lit(False)), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))).alias("v"))
    sound = (F.col("v").isNotNull()) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    digest = F.sha2(F.to_json(F.struct(F.col("label"), F.col("v"))), 256)
    rows = rows.select("vec_id", "label", "v", F.when(sound, digest).alias("same"))
    distinct = stored(rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("id"), F.first("label").alias("label"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    # a class goes by a hash of its digest, for ids of different vectors may be equal in odd input
    coded = distinct.select(F.xxhash64("same").alias("id"), "label", "copies", "v").mapInArrow(tidy(_sign(tables, bits)), "id long, label long, copies long, v array<double>, signs binary")
    coded = stored(coded, "signs")
    place = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")
    keyed = coded.select("*", place).withColumn("bucket", F.xxhash64("label", "table", F.size("v"), F.expr("substring(signs, 1 + 4 * table, 4)")))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select(apart("bucket").alias("k"), "m")
    shared = keyed.withColumn("bk", apart("bucket")).join(sizes, F.col("bk") == F.col("k")).drop("k", "bk")
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    shared = shared.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    units = shared.select("id", "copies", "v", "signs", "table", "bucket", "mine", other)
    units = units.select("id", "copies", "v", "signs", "table", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), F.when(F.col("mine") != F.col("other"), (F.col("mine") > F.col("other")).cast("int")).alias("side"))
    found = stored(units.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(tidy(_compare(threshold, tables)), _LINKS), "links")
    named = linked_classes(distinct.select(F.xxhash64("same").alias("id"), F.col("id").alias("least"), "copies"), found)
    named = named.select(apart("id").alias("nk"), "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("same").isNotNull(), apart(F.xxhash64("same"))).alias("rk")).join(named, F.col("rk") == F.col("nk"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def embedding_links(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings.select("vec_id", "embedding", "label"))
