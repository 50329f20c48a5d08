"""How far the sources of a language differ in their words: exact divergences of all pairs of sources.

Counts become integer shares p of each kept term; two sources differ by the sum over all kept terms
of floor((p - q)^2 / (p + q)). Were its count 0 in both sources, a term would add what the two smoothed shares of no count give, the
same for every term, so that is one product. Most terms stand in few sources, so what the counts
change in it is split:

* a term in many sources is heavy: tiles of terms times sources are dense int64 arrays, and a tile
  of one block of sources against another adds up all of their pairs by numpy;
* any other term is light. What a source's own counts change depends on the count alone: one number
  for each count and other source. Only the pairs of sources that share a light term need more,
  from the pairs of its postings.

All parts are integers and are added exactly, so neither the threshold nor the order of tasks shows
in the result. Terms are counted within tasks before they are shuffled; sources are dealt into
blocks, so no task holds all sources' terms or all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import joined
from .textcore import ALNUM, groups, slices, small_batches, stored, tidy, word_spans

LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: A term in more than this share of its language's sources is heavy.
HEAVY = 0.25
#: Terms of a dense tile, sources of a block, and bytes of texts whose words are counted together.
TILE, BLOCK, SLICE = 512, 128, 4 << 20
_ALPHA = ALNUM.copy()
_ALPHA[48:58] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- counting -------------------------------------------------------------------------------


def _slice_counts(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a slice, and for each (word, group) that occurs: word, group, occurrences, documents."""
    starts, ends, ptr = word_spans(buf, offs, _ALPHA)
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(_LOWER[buf[_ALPHA[buf]]])]).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    n = max(1, len(words.dictionary))
    by_doc, times = np.unique(np.repeat(np.arange(len(offs) - 1), np.diff(ptr)) * n + code, return_counts=True)
    key, at = np.unique(group[by_doc // n] * n + by_doc % n, return_inverse=True)
    return words.dictionary, key % n, key // n, np.bincount(at, weights=times, minlength=len(key)).astype(np.int64), np.bincount(at, minlength=len(key))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by (lang, source) in each slice; a row of the empty word for each group, for one may have no words."""
    for b in batches:
        for lo, hi, buf, offs in slices(b.column("text"), SLICE):
            names = [pc.dictionary_encode(b.column(c).slice(lo, hi - lo)) for c in ("lang", "source")]
            lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
            m = len(names[1].dictionary)
            kinds, group = np.unique(lang * m + source, return_inverse=True)
            terms, word, of, times, docs = _slice_counts(buf, offs, group)
            word = np.concatenate([word, np.full(len(kinds), len(terms))])
            of = np.concatenate([of, np.arange(len(kinds))])
            terms = pa.concat_arrays([terms, pa.array([""], pa.string())]).take(pa.array(word))
            pad = np.zeros(len(kinds), np.int64)
            yield pa.RecordBatch.from_arrays([
                names[0].dictionary.take(pa.array(kinds[of] // m)), names[1].dictionary.take(pa.array(kinds[of] % m)), terms,
                pa.array(np.concatenate([times, pad])), pa.array(np.concatenate([docs, pad])),
            ], names=["lang", "source", "term", "n", "docs"])


def group_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text), and a row of the empty term for each group."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(tidy(_count), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shares and differences, in numpy and as columns ------------------------------------------


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / total), three digits at a time, for SCALE * n may leave int64."""
    rest, out = n + 2, 0
    for _ in range(3):
        rest = rest * 1000
        q = rest // total
        out, rest = out * 1000 + q, rest - q * total
    return 1 + out


def differs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _share(n: Column, total: Column) -> Column:
    out, rest = F.lit(0).cast("long"), n + 2
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, total), rest % total
    return out + 1


def _differs(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# --- sums over pairs of sources -----------------------------------------------------------------

_PAIRS = "lang string, a long, b long, value long"


def _pairs(langs: pa.Array, lang: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Sums by pair of sources, the smaller number first; ``lang`` has places in ``langs``."""
    keys, at = np.unique(np.stack([lang, np.minimum(a, b), np.maximum(a, b)]), axis=1, return_inverse=True)
    total = np.zeros(keys.shape[1], np.int64)
    np.add.at(total, at.ravel(), value)
    return pa.RecordBatch.from_arrays([langs.take(pa.array(keys[0])), *(pa.array(x) for x in (keys[1], keys[2], total))], names=["lang", "a", "b", "value"])


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A unit is a tile of terms with one or two blocks of sources: the sums of all pairs within it or across the two.

    They are taken less what the terms would add if their counts were 0, for a term of the tile that no source
    of the unit has is not seen here. A row with a negative count has no term: it names a source, which may
    have none of the tile's terms.
    """
    for _, t in groups(batches, "unit"):
        source, count, tid = (t.column(c).to_numpy() for c in ("id", "n", "tid"))
        ids, first, row = np.unique(source, return_index=True, return_inverse=True)
        half = t.column("side").to_numpy()[first]
        terms, col = np.unique(tid[count >= 0], return_inverse=True)
        n = np.zeros((len(ids), len(terms)), np.int64)
        n[row[count >= 0], col] = count[count >= 0]
        total = t.column("total").to_numpy()[first]
        p, none = shares(n, total[:, None]), shares(np.zeros(len(total), np.int64), total)
        a, b = (np.flatnonzero(half == h) for h in (0, 1))
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, i in enumerate(a.tolist()):
            others = b if len(b) else a[k + 1 :]
            if len(others):
                got.append((np.full(len(others), ids[i]), ids[others], differs(p[i][None, :], p[others]).sum(1) - len(terms) * differs(none[i], none[others])))
        if got:
            x, y, v = (np.concatenate(c) for c in zip(*got, strict=True))
            yield _pairs(t.column("lang").slice(0, 1).combine_chunks(), np.zeros(len(x), np.int64), x, y, v)


#: Pairs of postings whose sums are taken together.
_TOGETHER = 1 << 18


def _posting_pairs(lengths: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, place) of all pairs of postings of a row, about ``_TOGETHER`` at a time."""
    for k in np.unique(lengths[lengths > 1]).tolist():
        rows = np.flatnonzero(lengths == k)
        if k * k > _TOGETHER:
            for r in rows.tolist():
                for i in range(k - 1):
                    yield np.full(k - 1 - i, r), np.full(k - 1 - i, off[r] + i), off[r] + np.arange(i + 1, k)
            continue
        i, j = np.triu_indices(k, 1)
        for some in np.array_split(rows, -(-len(rows) * len(i) // _TOGETHER)):
            yield np.repeat(some, len(i)), (off[some][:, None] + i).ravel(), (off[some][:, None] + j).ravel()


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of light terms' postings the pairs of sources, and by how much they miss the one-sided sums."""
    for batch in batches:
        langs = pc.dictionary_encode(batch.column("lang"))
        off = batch.column("post").offsets.to_numpy()
        ids, n, total = (batch.column("post").values.field(c).to_numpy() for c in ("id", "n", "total"))
        none, p = shares(np.zeros(len(n), np.int64), total), shares(n, total)
        for row, i, j in _posting_pairs(np.diff(off), off):
            v = differs(p[i], p[j]) - differs(p[i], none[j]) - differs(none[i], p[j]) + differs(none[i], none[j])
            yield _pairs(langs.dictionary, langs.indices.to_numpy()[row].astype(np.int64), ids[i], ids[j], v)


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a source's light counts add against each source of a block, as if that had none of them."""
    for b in batches:
        for r in range(b.num_rows):
            counts, terms = (b.column("own")[r].values.field(c).to_numpy() for c in ("n", "terms"))
            ids, totals = (b.column("theirs")[r].values.field(c).to_numpy() for c in ("id", "total"))
            me, total = b.column("id")[r].as_py(), np.int64(b.column("total")[r].as_py())
            none, theirs = shares(np.zeros(1, np.int64), total), shares(np.zeros(len(ids), np.int64), totals)
            v = np.zeros(len(ids), np.int64)
            for lo in range(0, len(counts), 4096):
                gain = differs(shares(counts[lo : lo + 4096], total)[:, None], theirs[None, :]) - differs(none, theirs)[None, :]
                v += (gain * terms[lo : lo + 4096, None]).sum(0)
            other = ids != me
            if other.any():
                yield _pairs(b.column("lang").slice(r, 1), np.zeros(int(other.sum()), np.int64), np.full(int(other.sum()), me), ids[other], v[other])


def _block(of: Column) -> Column:
    return F.floor(of / BLOCK).cast("long")


def _pair_sums(rows: DataFrame, sources: DataFrame, heavy_terms: DataFrame, heavy: float, tile: int) -> DataFrame:
    """(lang, a, b, value): the parts of the pairs' sums that counts of terms give, a < b.

    rows(lang, term, n, in_sources, id, m, total); sources(lang, id, total, m); heavy_terms(lang, heavy).
    """
    many = F.col("in_sources") > heavy * F.col("m")
    tiles = F.greatest(F.ceil(F.col("heavy") / tile), F.lit(1)).cast("long")
    last = sources.select("lang", F.floor((F.col("m") - 1) / BLOCK).cast("long").alias("last")).distinct()
    by_lang = heavy_terms.join(last, "lang").where("heavy > 0").select("lang", tiles.alias("tiles"), "last")
    cells = joined(rows.where(many).select("lang", "id", "total", "n", F.xxhash64("term").alias("tid")), by_lang, "lang")
    cells = cells.withColumn("tile", F.pmod(F.xxhash64("tid"), F.col("tiles")))
    named = joined(sources.select("lang", "id", "total"), by_lang, "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    both = cells.unionByName(named.withColumns({"n": F.lit(-1).cast("long"), "tid": F.lit(0).cast("long")})).withColumn("mine", _block(F.col("id")))
    both = both.select("lang", "id", "total", "n", "tid", "tile", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"))
    units = both.select("lang", "id", "total", "n", "tid", F.xxhash64("lang", "tile", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    dense = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(tidy(_dense), _PAIRS)

    light = rows.where(~many)
    post = light.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "n", "total")).alias("post")).where(F.size("post") > 1).select("lang", "post")  # heavy * m postings at most
    own = light.groupBy("lang", "id", "total", "n").agg(F.count("*").alias("terms")).groupBy("lang", "id", "total").agg(F.collect_list(F.struct("n", "terms")).alias("own"))
    theirs = sources.groupBy("lang", _block(F.col("id")).alias("block")).agg(F.collect_list(F.struct("id", "total")).alias("theirs")).drop("block")
    sided = own.join(theirs, "lang").mapInArrow(tidy(_one_sided), _PAIRS)
    return dense.unionByName(post.mapInArrow(tidy(_sparse), _PAIRS)).unionByName(sided).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP_TERMS, heavy: float = HEAVY, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows set each source of a language against each
    other one, ``term`` rows give the ``top`` terms of which a source has more than its language.

    A null text, lang or source is the empty one. A source without words has its rows, a language without a
    kept term pairs of value 0, a source alone in its language no pair. Equal values stand by their item's bytes.
    Repeated rows are documents of their own; other columns are not looked at; no rows give no rows.
    """
    counts = stored(group_terms(docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))), "audit-counts")
    known = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"), F.count("*").alias("in_sources")).where(F.col("docs") >= least).drop("docs")
    kept = stored(counts.where("term <> ''").drop("docs").join(known, ["lang", "term"]), "audit-kept")
    # a row for each source of a language, numbered in it
    names = Window.partitionBy("lang")
    numbered = counts.where("term = ''").select("lang", "source", (F.row_number().over(names.orderBy("source")) - 1).cast("long").alias("id"), F.count("*").over(names).alias("m"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    totals = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    words = kept.groupBy("lang", "term").agg(F.first("in_sources").alias("in_sources")).join(numbered.select("lang", "m").distinct(), "lang")
    words = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum((F.col("in_sources") > heavy * F.col("m")).cast("long")).alias("heavy"))
    none = F.lit(0).cast("long")
    sources = numbered.join(own, ["lang", "source"], "left").join(totals.join(words, "lang"), "lang", "left").na.fill(0, ["own", "lang_n", "v", "heavy"])
    sources = stored(sources.select("lang", "source", "id", "m", "v", "heavy", (F.col("own") + 2 * F.col("v")).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total")), "audit-sources")
    rows = joined(kept, sources.select("lang", "source", "id", "m", "total", "lang_total"), "lang", "source")

    p, q = _share(F.col("n"), F.col("total")), _share(F.col("in_lang"), F.col("lang_total"))
    over = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", _differs(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    heavy_terms = sources.select("lang", "heavy").distinct()
    sums = _pair_sums(rows, sources, heavy_terms, heavy, tile)
    a = sources.select("lang", F.col("source").alias("source_a"), F.col("id").alias("a"), F.col("total").alias("total_a"), "v")
    b = sources.select("lang", F.col("source").alias("source_b"), F.col("id").alias("b"), F.col("total").alias("total_b"))
    smooth = _differs(_share(none, F.col("total_a")), _share(none, F.col("total_b")))
    base = F.when(F.col("v") > 0, F.col("v") * smooth).otherwise(none)  # no term, no share
    pairs = a.join(b, "lang").where("a < b").withColumn("base", base).join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source_a", "source_b", (F.col("base") + F.coalesce("value", none)).alias("value"))
    sides = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("s")
    ranked = pairs.select("lang", "value", sides).select("lang", "s.source", "s.item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(best)


def divergence_digest(docs: DataFrame) -> DataFrame:
    return audit(docs)
