"""Jaccard self-join of word n-gram sets by chosen paths.

Equal sets are one from the start. A set is a sketch of ``width`` tokens (least hashes, of which two bytes go along), of which
two sets of similarity s share each with probability s. Each run grows a tree of paths from a
root that holds all sets: a hash of the path alone samples one token place, or at times two, so
that ``1 / threshold`` are sampled on average, and a set goes on to a branch for each, named by
its token there. Two sets at the threshold so share one branch in the mean at every step. A
bucket is split further until it has at most ``small`` sets, or until a step leaves most of it
together: then its sets are alike, and it is compared whole, as it is ``DEEPEST`` levels down. Large buckets are dealt into blocks
and each pair of blocks is a unit of work, so hot groups neither drop a pair nor fill one task.
Runs are repeated until a pair at the threshold is found with probability ``recall`` at the
depth that the trees have reached.

Units first carry sketches alone; only sets with a promising partner are then built again from
their texts and compared token by token. What the sketches may refuse wrongly is part of the
recall. A pair belongs to the first bucket that it shares, so links count once, and units return
counts and connecting edges instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import least_labels, linked_classes
from .textcore import NON_SPACE, apart, as_strings, fixed_binary, groups, mix, ngram_hash, partitions, prefix_hash, seeds, slices, small_batches, span_hash, stored, tidy, word_spans

N = 5
THRESHOLD = 0.8
WIDTH = 48
RECALL = 0.9999
SMALL = 128
BLOCK = 512
#: Share of a bucket in one of its branches from which its sets count as alike.
DENSE = 0.6
#: Levels that the first runs allow for, more runs following if the trees grow deeper; at the deepest, a bucket is compared however large.
LEVELS, DEEPEST = 3, 5
_U = np.uint64


def _binomial(width: int, p: float) -> np.ndarray:
    return np.array([math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(width + 1)])


def runs_for(threshold: float, levels: int, recall: float, width: int = WIDTH) -> int:
    """Runs after which a pair at the threshold shares no bucket, ``levels`` deep, with half of what ``recall`` leaves at most.

    The pair shares a token place with its share of equal sketch tokens, whatever that has turned
    out to be; a path that samples two places goes on if either is shared.
    """
    twice, equal = 1 / threshold - 1, np.arange(width + 1) / width
    lost = np.zeros(width + 1)
    for _ in range(levels):
        g = 1 - equal + equal * lost
        lost = (1 - twice) * g + twice * g * g
    odds, runs = _binomial(width, threshold), 1
    while (odds * lost**runs).sum() > (1 - recall) / 2:
        runs += 1
    return runs


def least_equal(threshold: float, recall: float, width: int = WIDTH) -> int:
    """Equal sketch tokens that all but half of what ``recall`` leaves of the pairs at the threshold have."""
    return int(np.searchsorted(np.cumsum(_binomial(width, threshold)), (1 - recall) / 2, "right"))


def sets(buf: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted n-gram hashes; a text of fewer words, but not none, has one gram of all."""
    starts, ends, ptr = word_spans(buf, offs, NON_SPACE)
    words = span_hash(prefix_hash(buf), starts, ends) if len(starts) else np.zeros(0, _U)
    grams = ngram_hash(words, n)
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield mix(ngram_hash(words[a:b], b - a) + _U(b - a)) if b > a else np.zeros(0, _U)


def _key(s: np.ndarray) -> int:
    """A 64-bit digest of a set: sums of two mixings, mixed with the size."""
    with np.errstate(over="ignore"):
        a = mix(s + _U(1)).sum(dtype=_U)
        b = np.bitwise_xor.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)))
        return int(mix(np.array([a ^ (b * _U(3)) + _U(len(s))], _U))[0].view(np.int64))


def _sketch(n: int, t: int, text: str):
    odd = (seeds(t, 29) | _U(1)) if t else np.zeros(0, _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, size, sig, high = [], [], [], []
            for lo, hi, buf, offs in slices(as_strings(b.column(text))):
                own = list(sets(buf, offs, n))
                full = [s for s in own if len(s)]
                if full:
                    h, first = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
                    sketch, above = np.empty((len(full), t), np.uint16), np.empty((len(full), t), np.uint16)
                    for c in range(t):
                        least = mix(np.minimum.reduceat(h * odd[c], first))
                        sketch[:, c], above[:, c] = least & _U(0xFFFF), (least >> _U(16)) & _U(0xFFFF)
                at = iter(range(len(full)))
                for s in own:
                    size.append(len(s))
                    keys.append(_key(s) if len(s) else None)
                    k = next(at) if len(s) else None
                    sig.append(None if k is None else sketch[k].tobytes())
                    high.append(None if k is None else above[k].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(keys, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(high, pa.binary())], names=["doc_id", "digest", "key", "size", "sig", "high"])

    return run


class _Unit:
    """Rows of one unit of work, and which of their pairs it owns and finds promising."""

    def __init__(self, t: pa.Table, width: int, threshold: float, equal: int):
        self.ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        self.table = t
        size = t.column("size").to_numpy().astype(np.float32)
        side = t.column("side").to_numpy(zero_copy_only=False).astype(np.float32)
        near = size[:, None] >= (size * np.float32(threshold - 1e-6))[None, :]
        pairs = near & near.T
        np.fill_diagonal(pairs, False)
        if not np.isnan(side).all():
            pairs &= side[:, None] != side[None, :]
        if pairs.any():
            pairs &= ~self._met_before(t.column("buckets").combine_chunks(), t.column("bucket")[0].as_py())
        sig, left = fixed_binary(t.column("sig"), np.uint16, width), int(pairs.sum())
        if 8 * left < pairs.size:  # a few pairs one by one, many by columns
            i, j = np.nonzero(pairs)
            for lo in range(0, left, 100_000):
                x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
                pairs[x, y] = (sig[x] == sig[y]).sum(1) >= equal
        else:
            same = np.zeros(pairs.shape, np.uint8)
            for c in range(width):
                same += sig[:, c][:, None] == sig[:, c][None, :]
            pairs &= same >= equal
        self.pairs = pairs

    @staticmethod
    def _met_before(buckets: pa.ListArray, here: int) -> np.ndarray:
        """Pairs that share a bucket of smaller number than ``here``."""
        off, all_of = buckets.offsets.to_numpy(), buckets.values.to_numpy()
        row = np.repeat(np.arange(len(buckets)), np.diff(off))
        own = all_of[off[0] : off[-1]]
        row, own = row[own < here], own[own < here]
        _, col, n = np.unique(own, return_inverse=True, return_counts=True)
        number, keep = np.cumsum(n > 1) - 1, (n > 1)[col]
        m = np.zeros((len(buckets), int((n > 1).sum())), np.float32)
        m[row[keep], number[col[keep]]] = 1
        return (m @ m.T) > 0


def _promising(width: int, threshold: float, equal: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "unit"):
            if t.num_rows > 1:
                u = _Unit(t, width, threshold, equal)
                some = np.flatnonzero(u.pairs.any(1))
                if len(some):
                    out = u.table.take(pa.array(some)).combine_chunks()
                    yield from out.to_batches()

    return run


def _with_sets(n: int):
    """The sets of the texts that stand for their class, for each unit that wants them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in slices(as_strings(b.column("text"))):
                part = b.slice(lo, hi - lo)
                rows, blobs = [], []
                for i, (s, key) in enumerate(zip(sets(buf, offs, n), part.column("id").to_pylist(), strict=True)):
                    if len(s) and _key(s) == key:
                        rows.append(i)
                        blobs.append(s.tobytes())
                if rows:
                    kept = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("wanted"), pa.array(blobs, pa.binary())], names=["id", "wanted", "grams"])

    return run


def shared_counts(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of blocks of columns."""
    n = len(grams)
    out = np.zeros((n, n), np.float32)
    rows = np.repeat(np.arange(n), [len(g) for g in grams])
    _, col, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    often = count > 1  # a gram of one set adds to no intersection
    number = np.cumsum(often) - 1
    keep = often[col]
    rows, col = rows[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    total = int(often.sum())
    for lo in range(0, total, 8192):
        a, b = np.searchsorted(col, [lo, lo + 8192])
        m = np.zeros((n, min(8192, total - lo)), np.float32)
        m[rows[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verify(width: int, threshold: float, equal: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "unit"):
            if t.num_rows < 2:
                continue
            u = _Unit(t, width, threshold, equal)
            if not u.pairs.any():
                continue
            grams = [np.frombuffer(g, _U) for g in u.table.column("grams").to_pylist()]
            size, copies = np.array([len(g) for g in grams], float), u.table.column("copies").to_numpy()
            both = shared_counts(grams).astype(float)
            linked = u.pairs & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9)
            n = linked @ copies
            some = np.flatnonzero(n)
            if len(some):
                low = least_labels(linked)
                yield pa.RecordBatch.from_arrays([pa.array(u.ids[some]), pa.array(n[some].astype(np.int64)), pa.array(u.ids[low[some]])], names=["id", "n", "root"])

    return run


def _split(live: DataFrame, width: int, threshold: float) -> DataFrame:
    """The branches of rows (id, sig, high, path, used, m): id, path, used, parent (the size of the bucket that was split).

    ``used`` has a bit for each token place on the path, which is not sampled again. At the root,
    which holds all sets, tokens have the two bytes of ``high`` more; past it that is empty.
    """
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), "path"), F.lit(width)).cast("int")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    free = lambda i, used: F.when(used.bitwiseAND(bit(i)) == 0, i)
    rows = live.withColumn("one", F.coalesce(*(free(at(k), F.col("used")) for k in range(4)), at(0)))
    rows = rows.withColumn("used", F.col("used").bitwiseOR(bit(F.col("one"))))
    often = F.pmod(F.xxhash64(F.lit(-1), "path"), F.lit(1 << 20)) < int((1 / threshold - 1) * (1 << 20))
    rows = rows.withColumn("two", F.when(often, F.coalesce(*(free(at(k), F.col("used")) for k in range(4, 8)))))
    rows = rows.withColumn("place", F.explode(F.filter(F.array("one", "two"), lambda i: i.isNotNull())))
    two_bytes = lambda c: F.substring(F.col(c), 1 + 2 * F.col("place"), F.lit(2))
    token = F.concat(two_bytes("high"), two_bytes("sig"))
    mask = F.col("used").bitwiseOR(bit(F.col("place")))
    return rows.select("id", F.xxhash64("path", "place", token).alias("path"), mask.alias("used"), F.col("m").alias("parent"))


def _buckets(classes: DataFrame, threshold: float, recall: float, small: int, width: int) -> DataFrame:
    """(id, path, m) of the buckets of two sets or more in which paths end."""
    done, ran, levels, everything = [], 0, 0, classes.count()
    while ran < (runs := runs_for(threshold, max(levels, LEVELS), recall, width)):
        live = classes.select("id", "sig", "high", F.explode(F.sequence(F.lit(ran), F.lit(runs - 1))).alias("run")).select("id", "sig", "high", F.xxhash64(F.lit("root"), "run").alias("path"), F.lit(0).cast("long").alias("used"), F.lit(everything).cast("long").alias("m"))
        ran, level = runs, 0
        while True:
            grown = _split(live, width, threshold)
            counts = grown.groupBy("path").agg(F.count("*").alias("m")).where("m > 1").select(apart("path").alias("k"), "m")  # what is alone has no partner there
            rows = stored(grown.withColumn("pk", apart("path")).join(counts, F.col("pk") == F.col("k")).drop("pk", "k"), "paths")
            over = (F.col("m") <= small) | (F.col("m") >= DENSE * F.col("parent")) | F.lit(level + 1 == DEEPEST)
            done.append(rows.where(over).select("id", "path", "m"))
            live = rows.where(~over).select("id", "path", "used", "m")
            level += 1
            levels = max(levels, level)
            if live.isEmpty():
                break
            live = live.join(classes.select("id", "sig"), "id").withColumn("high", F.lit(b""))  # sketches of what is split again, not of all branches
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _linked(docs: DataFrame, doc_id: str, text: str, n: int, threshold: float, recall: float, small: int, block: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, digest, key, size of each row; id (the key), class_id, n_links, component_id, component."""
    spark = docs.sparkSession
    small_batches(spark)
    equal = least_equal(threshold, recall, width)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stored(base.withColumn("digest", F.xxhash64("text")).mapInArrow(tidy(_sketch(n, width, "text")), "doc_id long, digest long, key long, size long, sig binary, high binary"), "sketches")
    classes = rows.where("key is not null and doc_id is not null").groupBy(F.col("key").alias("id")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("high").alias("high"))
    classes = stored(classes, "classes")
    ended = _buckets(classes, threshold, recall, small, width)

    # each class with all its buckets, then its units of work
    paths = ended.groupBy("id").agg(F.collect_set(F.struct("path", "m")).alias("got"))  # about 1 / threshold a run and level
    full = paths.join(classes, "id").select("id", "size", "copies", "sig", F.transform("got", lambda g: g["path"]).alias("buckets"), F.explode("got").alias("g"))
    blocks = F.when(F.col("g.m") > small, F.ceil(F.col("g.m") / F.lit(block)).cast("int")).otherwise(1)
    units = full.select("id", "size", "copies", "sig", "buckets", F.col("g.path").alias("bucket"), blocks.alias("blocks")).withColumn("mine", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("id", "size", "copies", "sig", "buckets", "bucket", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), F.when(F.col("mine") != F.col("other"), (F.col("mine") > F.col("other")).cast("int")).alias("side"))
    some = units.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(tidy(_promising(width, threshold, equal)), units.schema)
    some = stored(some, "promising")

    # the sets of what has a promising partner, from the text of the class's first document
    wanted = some.groupBy("id").agg(F.collect_list(F.struct("unit", "bucket", F.coalesce("side", F.lit(-1)).alias("side"))).alias("wanted")).join(classes.select("id", "least"), "id")
    asked = base.join(wanted, F.col("doc_id") == F.col("least")).select("text", "id", "wanted")
    given = asked.mapInArrow(tidy(_with_sets(n)), "id long, wanted array<struct<unit:long,bucket:long,side:int>>, grams binary").dropDuplicates(["id"])
    facts = some.select("id", "size", "copies", "sig", "buckets").dropDuplicates(["id"])
    work = given.join(facts, "id").select("id", "size", "copies", "sig", "buckets", "grams", F.explode("wanted").alias("w")).select("id", "size", "copies", "sig", "buckets", "grams", F.col("w.bucket").alias("bucket"), F.col("w.unit").alias("unit"), F.when(F.col("w.side") >= 0, F.col("w.side")).alias("side"))
    found = stored(work.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(tidy(_verify(width, threshold, equal)), "id long, n long, root long"), "links")
    named = linked_classes(classes.select("id", "least", "copies"), found).join(classes.select("id", F.col("least").alias("class_id")), "id")
    return rows, named


def _settings(n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, width: int = WIDTH) -> dict:
    if not 2 <= width <= 63:
        raise ValueError("width: 2 to 63 tokens")
    return {"n": n, "threshold": threshold, "recall": recall, "small": small, "block": block, "width": width}


def jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per document: doc_id, n_grams, class_id, n_links, component_id, kept.

    ``settings``: n, threshold, recall, small, block, width, with the module's values.
    class_id is the least id with the same n-gram set, n_links counts the other rows whose set
    is equal or at least ``threshold`` similar, component_id is the least id connected by links,
    and kept marks it. Words are lower-cased (A-Z) runs without white space; a text of fewer
    than ``n`` words is one gram. Null, empty and blank texts have no grams, link with
    nothing and are kept; so are rows with a null id; repeated rows are copies, all kept if their
    id is; no rows give no rows.
    """
    rows, named = _linked(docs, doc_id, text, **_settings(**settings))
    named = named.select(apart("id").alias("nk"), "class_id", "n_links", "component_id")
    out = rows.select("doc_id", "size", F.when(F.col("doc_id").isNotNull(), apart("key")).alias("rk")).join(named, F.col("rk") == F.col("nk"), "left")
    return out.select("doc_id", F.col("size").alias("n_grams"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each group of linked rows, that of the smallest id, and one of rows with equal id and text.

    Each row is judged by its own text: rows that share an id with a group's row but not its
    words stay. Rows with a null id, and texts without words, are in no group.
    """
    rows, named = _linked(docs, doc_id, text, **_settings(**settings))
    rows = rows.where("doc_id is not null")
    grouped = rows.where("key is not null").withColumn("rk", apart("key")).join(named.select(apart("id").alias("nk"), "component"), F.col("rk") == F.col("nk")).select("component", "doc_id", "digest")
    first = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("c")).where("c > 1").select(apart("component").alias("fk"), "first")
    gone = grouped.withColumn("ck", apart("component")).join(first, F.col("ck") == F.col("fk")).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest"))).select("doc_id", "digest", F.lit(0).alias("stay"))
    again = rows.groupBy("doc_id", F.coalesce("digest", F.lit(0)).alias("digest")).count().where("count > 1").select("doc_id", "digest", F.lit(1).alias("stay"))
    fate = gone.union(again).groupBy(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest")).agg(F.min("stay").alias("_stay"))
    names = docs.columns
    judged = docs.withColumns({"_id": F.col(doc_id).cast("long"), "_digest": F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0))})
    judged = judged.join(fate, (F.col("_id") == F.col("f_id")) & (F.col("_digest") == F.col("f_digest")), "left").where("_stay is null or _stay = 1")
    once, twice = judged.where("_stay is null").select(*names), judged.where("_stay = 1")
    return once.unionByName(twice.dropDuplicates(["_id", "_digest"]).select(*names))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs.select("doc_id", "text"))
