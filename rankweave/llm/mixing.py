"""Mixing sources to target weights by systematic sampling.

Every document of a source has its expected copies, which weighted by size add up to the
source's target. The documents stand in the order of their size; one random offset is added to
the prefix sum of expected copies, and a document is emitted once per integer boundary that its
stretch of the sum crosses.

In the order of their size the words taken rise with the offset, by no more than the largest
document from one end to the other, so a source misses its target by that at most. Only where a
document is larger than ``MISS`` of its source's target are its expected copies whole numbers, rounded
from the common rate one after another so that what one has too much the next has less; all others
share what is then left of the target. Whole expected copies cross as many boundaries whatever the
offset. A source of many documents has none so large, and is sampled as one.

Ranks come from a range partitioning by (source, size, document): a source with a third of
all rows spreads over as many partitions as it fills, each counted once, and the sums over
the partitions before give the start of each. Nothing but a few sums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textcore import NON_SPACE, partitions, slices, small_batches, stored, tidy, word_spans

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: By what share of its target a source may miss it. Documents above that have whole expected copies, if they are
#: above an eighth of that share of their source too: 8 / MISS documents of a source at most.
MISS = 0.03
#: Rows of a table by source (and partition) that is sent to every task; larger ones are joined.
BROADCAST_ROWS = 100_000
#: Documents for each partition of the ranking.
PLACED = 2_000_000


def count_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` without its text, with the number of ``[^\\x20\\x09-\\x0D]+`` runs (null: 0)."""
    rest = [c for c in df.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.diff(word_spans(buf, offs, NON_SPACE)[2]) for _, _, buf, offs in slices(b.column(text))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(np.concatenate(n) if n else [], pa.int64())], names=[*rest, name])

    kind = df.select(*rest, F.lit(0).cast("long").alias(name)).schema
    return df.select(*rest, text).mapInArrow(tidy(run), kind)


def _ordered(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """``df`` written in ``order``, with ``part`` and ``at``: a row's partition, and a number that rises within it."""
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "mixing-order")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources(source, source_size) with target: ``share`` of all sizes by ``weights``, repeating in the order
    of the names (by code point, null last), none above ``cap`` times its size; what a capped source cannot
    take goes to the others by weight."""
    order = _ordered(sources, partitions(sources.sparkSession), F.col("source").asc_nulls_last())
    counts = order.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each partition
    before = counts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"))
    place = F.pmod(F.col("at") + F.col("shift"), F.lit(len(weights))).cast("int")
    weighed = order.join(F.broadcast(before), "part").select("source", "source_size", F.get(F.array(*map(F.lit, weights)), place).alias("w"))
    weighed, unit, most = stored(weighed, "mixing-weights"), 0.0, cap * F.col("source_size")
    total = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # the unit only rises, and with it the sources at their cap
        capped = F.col("w") * unit > most
        got = weighed.agg(F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("w")))).first()
        new = (total - (got[0] or 0.0)) / got[1] if got[1] else unit
        if new == unit:
            return weighed.select("source", "source_size", F.when(capped, most).otherwise(F.col("w") * unit).alias("target"))
        unit = new


def offset(source: Column, seed: int) -> Column:
    """An offset in [0, 1) drawn from the seed and the source's name, so reruns agree."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")), F.when(source.isNull(), ":null").otherwise(":"))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def joined(rows: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """Both on equal (null or not) columns; ``table`` is broadcast if it is short, else adaptive execution may split a hot source."""
    table = table.withColumnsRenamed({c: f"r_{c}" for c in on})
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return rows.join(table, match).drop(*(f"r_{c}" for c in on))


def _whole_copies(rate: Column) -> Column:
    """Of docs, an array of (size, ...) from the largest on, the copies of each: rate or its neighbour, errors carried on."""
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("taken"), F.array().cast("array<bigint>").alias("copies"))

    def step(s: Column, d: Column) -> Column:
        due = s["due"] + rate * d["size"]
        n = F.least(F.greatest(F.floor((due - s["taken"]) / d["size"] + 0.5), F.floor(rate)), F.ceil(rate)).cast("long")
        return F.struct(due.alias("due"), (s["taken"] + n * d["size"]).alias("taken"), F.concat(s["copies"], F.array(n)).alias("copies"))

    return F.aggregate("docs", start, step, lambda s: s["copies"])


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, miss: float = MISS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and copies.

    A null text has size 0, a null source is a source of its own and the last; repeated rows
    are documents of their own, documents of equal size stand by id, a null id first; a source of
    size 0 has target 0; no rows give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sized = count_words(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")), "text", "size")
    sized = stored(sized, "mixing-sizes")
    aims = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mixing-targets")
    rows = joined(sized, aims, "source")
    is_large = F.col("size") > F.greatest(F.lit(miss) * F.col("target"), F.lit(miss / 8) * F.col("source_size"))
    few = rows.where(is_large).groupBy("source", "source_size", "target").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id")), asc=False).alias("docs"))  # 8 / miss of a source at most
    few = few.withColumn("copies", _whole_copies(F.col("target") / F.col("source_size")))
    few = stored(few.select("source", "source_size", "target", F.arrays_zip("docs", "copies").alias("docs")), "mixing-large")
    firm = few.select("source", F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["copies"] * d["docs"]["size"]).alias("firm"), F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["docs"]["size"]).alias("large_size"))
    left = aims.join(firm.withColumnRenamed("source", "f"), F.col("source").eqNullSafe(F.col("f")), "left").na.fill(0, ["firm", "large_size"])
    rate = F.when(F.col("source_size") > F.col("large_size"), F.least(F.greatest((F.col("target") - F.col("firm")) / F.nullif(F.col("source_size") - F.col("large_size"), F.lit(0)), F.lit(0.0)), F.lit(cap))).otherwise(0.0)
    rates = stored(left.select("source", rate.alias("rate"), offset(F.col("source"), seed).alias("shift")), "mixing-rates")

    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    n = max(partitions(spark), -(-sized.count() // PLACED))
    placed = _ordered(rows.where(~is_large), n, *order)
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(joined(counts.select("source", "part", (before - F.col("first") + 1).alias("shift_at")), rates, "source"), "mixing-starts")
    many = joined(placed, starts, "source", "part")
    rank = F.col("at") + F.col("shift_at")
    copies = F.floor(rank * F.col("rate") + F.col("shift")) - F.floor((rank - 1) * F.col("rate") + F.col("shift"))
    names = ["doc_id", "size", "source_size", "target", "copies"]
    certain = few.select("source_size", "target", F.explode("docs").alias("d")).select(F.col("d.docs.doc_id").alias("doc_id"), F.col("d.docs.size").alias("size"), "source_size", "target", F.col("d.copies").alias("copies"))
    return many.withColumn("copies", copies.cast("long")).select(*names).unionByName(certain)


def mixing_digest(docs: DataFrame) -> DataFrame:
    """The mix as words taken from each document, repeats counted."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
