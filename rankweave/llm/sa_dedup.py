"""Repeated passages across documents, by suffix arrays of bounded shards.

A byte goes if a string of ``length`` bytes that covers it also starts in a document of smaller
id. Sorting all suffixes of a corpus against each other would move every suffix; instead
strings that could be equal are brought together by content:

1. Every string of ``length`` bytes has a least hash among its grams of ``gram`` bytes, its
   anchor, and equal strings have equal anchors. Each distinct text sends its anchors' hashes,
   packed by shard, and learns which of them another text has too.
2. Around those anchors alone the texts give segments: maximal stretches of strings with one
   anchor. Equal segments collapse to one with the smallest and largest id.
3. Segments meet in shards by their anchor. A shard sorts its suffixes by Larsson-Sadakane
   refinement (ranks of 8 bytes, then doubled within the unsorted groups), takes common prefixes
   of neighbours by Kasai's algorithm, and has the smallest id of every string. A shard of
   more than ``block`` bytes is several suffix arrays; where an anchor's segments lie in two of
   them, they are merged by binary search for each other's strings. An anchor with too many
   different segments is dealt by string instead.
4. Every segment learns where its strings have a smaller id than its documents; these become
   byte ranges of the documents.

Equal texts are judged on one of them: the first keeps what no earlier text has, and in all
others every byte is covered if they have ``length`` bytes at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import apart, as_strings, groups, mix, prefix_hash, rolling_hash, runs, slices, small_batches, span_hash, stored, tasks, tidy, total_bytes

LENGTH = 50
GRAM = 24
#: Text bytes for each shard of anchors, and of segments.
ANCHOR_SHARD = 16 << 20
SEGMENT_SHARD = 4 << 20
#: Bytes of one suffix array.
BLOCK = 1 << 20
#: Different segments of one anchor beyond which its strings are dealt one by one.
HOT_SEGMENTS = 20_000
#: Bytes of the largest array that a worker keeps to use again: those of one slice.
HEAP = 4 << 20
_U = np.uint64


# --- suffix arrays ----------------------------------------------------------------------


def _first_ranks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first 8 bytes, and each suffix's rank: the place where its group begins."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, _U)
    for j in range(8):
        key = (key << _U(8)) | padded[j : j + n].astype(_U)
    sa = np.argsort(key)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return sa, rank


def _refine(sa: np.ndarray, rank: np.ndarray, step: int) -> bool:
    """Larsson-Sadakane: within groups of equal rank, sort by the rank ``step`` further on.

    Groups of one are left alone; ``sa`` and ``rank`` change in place. False if there were no others.
    """
    n = len(sa)
    sorted_rank = rank[sa]
    alone = np.ones(n, bool)
    same = sorted_rank[1:] == sorted_rank[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    at = np.flatnonzero(~alone)
    if not len(at):
        return False
    own = sa[at]
    further = own + step
    key = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
    group = sorted_rank[at]
    order = np.argsort(group * (n + 1) + key)
    own, key, group = own[order], key[order], group[order]
    sa[at] = own
    new = np.ones(len(at), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    rank[own] = np.maximum.accumulate(np.where(new, at, 0))
    return True


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the place of each suffix in it."""
    sa, rank = _first_ranks(text)
    have = 8
    while len(text) and _refine(sa, rank, have):
        have *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """Common prefix, ``cap`` at most, of each suffix with its predecessor in the suffix array, by Kasai's algorithm.

    In text order a suffix has with its predecessor all but one byte of what the suffix before
    had, so comparison starts there. The text is cut into lanes of ``lane`` bytes, each with a
    carry of its own, that go side by side and compare eight bytes at a time.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int32)
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (n + cap + 8, 8), (1, 1)).copy().view("<u8").ravel()  # the first byte is the lowest
    lanes = -(-n // lane)
    before = np.full(lanes * lane, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    before = np.ascontiguousarray(before.reshape(lanes, lane).T)
    plcp = np.zeros((lane, lanes), np.int32)
    first, h = np.arange(0, lanes * lane, lane, dtype=np.int32), np.zeros(lanes, np.int32)
    for step in range(lane):
        j = before[step]
        live = np.flatnonzero((j >= 0) & (h < cap))
        h[j < 0] = 0
        a, b, k = first[live] + np.int32(step), j[live], h[live]
        top = np.minimum(np.int32(n) - np.maximum(a, b), np.int32(cap))
        a, b = a + k, b + k
        while len(live):
            x = word[a] ^ word[b]
            low = (x & (~x + _U(1))).astype(np.float64)  # its lowest set bit, whose exponent tells the byte
            same = np.where(x == 0, 8, ((low.view(np.int64) >> 52) - 1023) >> 3).astype(np.int32)
            k = np.minimum(k + same, top)
            h[live] = k
            on = np.flatnonzero((same == 8) & (k < top))
            live, a, b, k, top = live[on], a[on] + np.int32(8), b[on] + np.int32(8), k[on], top[on]
        plcp[step] = h
        h = np.maximum(h - 1, 0)
    return plcp.T.ravel()[:n][sa]


class _Block:
    """A suffix array of segments: their strings in order, and the smallest id of each."""

    def __init__(self, text: np.ndarray, offs: np.ndarray, least: np.ndarray, anchor: np.ndarray, length: int):
        self.number = np.diff(offs) - length + 1  # strings that start in each segment
        starts = runs(offs[:-1], self.number)
        self.owner, self.anchor = np.repeat(np.arange(len(self.number)), self.number), anchor
        sa, _ = suffix_array(text)
        lcp = common_prefixes(text, sa, length)
        valid = np.zeros(len(text), bool)
        valid[starts] = True
        at = np.flatnonzero(valid[sa])
        order = sa[at]
        # the common prefix of two starts is the least over all suffixes between them
        lcp = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else lcp[:0]
        new = lcp < length
        new[:1] = True
        of = np.empty(len(text), np.int64)
        of[order] = np.cumsum(new) - 1
        self.group = of[starts]
        self.first = order[new]
        self.text, self.length = text, length
        place = np.empty(len(text), np.int64)
        place[starts] = self.owner
        self.least = np.minimum.reduceat(least[place[order]], np.flatnonzero(new)) if len(at) else np.zeros(0, np.int64)

    def strings(self, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """The different strings of an anchor's segments, in order, and their numbers."""
        own = np.unique(self.group[(self.anchor == anchor)[self.owner]])
        rows = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[self.first[own]]
        return np.ascontiguousarray(rows).view(f"S{self.length}").ravel(), own

    def merge(self, other: _Block) -> None:
        """Give both the smaller id of every string that both have; an anchor in both is the last here and the first there."""
        if self.anchor[-1] != other.anchor[0]:
            return
        (a, mine), (b, its) = self.strings(self.anchor[-1]), other.strings(self.anchor[-1])
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = np.flatnonzero(b[at] == a)
        mine, its = mine[both], its[at[both]]
        low = np.minimum(self.least[mine], other.least[its])
        self.least[mine], other.least[its] = low, low


def shard_least(data: np.ndarray, offs: np.ndarray, least: np.ndarray, anchor: np.ndarray, length: int, block: int = BLOCK) -> np.ndarray:
    """The smallest id among all segments with a string, of each string of each segment ``data[offs[i]:offs[i+1]]``; segments stand by their anchor."""
    blocks, lo = [], 0
    while lo < len(least):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block, "right")) - 1)
        blocks.append(_Block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], least[lo:hi], anchor[lo:hi], length))
        lo = hi
    for _ in range(2 if len(blocks) > 2 else 1):  # the second round carries ids back to earlier blocks
        for i, a in enumerate(blocks):
            for b in blocks[i + 1 :]:
                if a.anchor[-1] != b.anchor[0]:
                    break  # nor do later blocks have it
                a.merge(b)
    return np.concatenate([b.least[b.group] for b in blocks]) if blocks else np.zeros(0, np.int64)


# --- anchors ------------------------------------------------------------------------------


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of strings with one anchor: first string's start, number of strings, anchor hash.

    Equal neighbours of one text only; a text shorter than ``length`` has none.
    """
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    low = rolling_hash(buf, gram)
    width, have = length - gram + 1, 1
    while have < width:  # minima of windows, doubled
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    size = np.diff(offs)
    number = np.maximum(size - length + 1, 0)
    inside = runs(offs[:-1], number)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    h = low[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (h[1:] != h[:-1]) | (inside[1:] != inside[:-1] + 1)
    new[(np.cumsum(number) - number)[number > 0]] = True  # texts stand side by side
    first = np.flatnonzero(new)
    return inside[first], np.diff(np.append(first, len(inside))), mix(h[first])  # minima are small: spread them again


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(40)) * _U(n) >> _U(24)).astype(np.int64)


def _blobs(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` items each from one array."""
    off = np.concatenate([[0], np.cumsum(sizes * data.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _send(length: int, gram: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = b.column("same").to_numpy()
            for lo, _, buf, offs in slices(as_strings(b.column("text"))):
                start, _, h = anchors(buf, offs, length, gram)
                if not len(h):
                    continue
                doc = np.searchsorted(offs, start, "right") - 1
                shard = _shard(h, shards)
                order = np.argsort(doc * shards + shard, kind="stable")
                key = (doc * shards + shard)[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array((key[first] % shards).astype(np.int32)), pa.array(same[lo + key[first] // shards]), _blobs((h[order] & _U(0xFFFFFFFF)).astype(np.uint32), np.diff(np.append(first, len(key))))], names=["shard", "same", "hashes"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text in a shard the anchors that another text of the shard has as well."""
    for shard, t in groups(batches, "shard"):
        same, col = t.column("same").to_numpy(), t.column("hashes").combine_chunks()
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        h = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32)
        size = np.diff(off) // 4
        names, own = np.unique(same, return_inverse=True)
        own = np.repeat(own, size).astype(_U)
        pairs = np.unique((h.astype(_U) << _U(32)) | own)
        top = (pairs >> _U(32)).astype(np.uint32)
        twice = top[1:][top[1:] == top[:-1]]
        del pairs, top
        twice = np.unique(twice)
        if not len(twice):
            continue
        hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        pairs = np.unique((own[hit] << _U(32)) | h[hit].astype(_U))
        who, cut = np.unique(pairs >> _U(32), return_index=True)
        number = np.diff(np.append(cut, len(pairs)))
        for a in range(0, len(who), 20_000):
            z = slice(a, a + 20_000)
            lo, hi = int(cut[a]), int(cut[a] + number[z].sum())
            yield pa.RecordBatch.from_arrays([pa.array(names[who[z].astype(np.int64)]), pa.array(np.full(len(who[z]), shard, np.int32)), _blobs((pairs[lo:hi] & _U(0xFFFFFFFF)).astype(np.uint32), number[z])], names=["same", "shard", "hashes"])


class _Combiner:
    """Segments that a task has sent, so that a common one goes out once and not per document."""

    MOST = 1_000_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.low, self.multi = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows (key, id): one row of each key that says anything new, its least id, and whether there are several."""
        order = np.lexsort((ids, key))
        k, i = key[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.append(first[1:], len(k)) - 1
        k, low, multi, row = k[first], i[first], i[first] != i[last], order[first]
        if len(self.keys) > self.MOST:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, k), max(0, len(self.keys) - 1))
        known = self.keys[at] == k if len(self.keys) else np.zeros(len(k), bool)
        old_low, old_multi = self.low[at[known]], self.multi[at[known]]
        more = np.ones(len(k), bool)
        new_multi = multi[known] | old_multi | (old_low != low[known])
        more[known] = (low[known] < old_low) | (new_multi & ~old_multi)
        low[known], multi[known] = np.minimum(low[known], old_low), new_multi
        self.low[at[known]], self.multi[at[known]] = low[known], multi[known]
        fresh = ~known
        where = np.searchsorted(self.keys, k[fresh])
        self.keys, self.low, self.multi = np.insert(self.keys, where, k[fresh]), np.insert(self.low, where, low[fresh]), np.insert(self.multi, where, multi[fresh])
        return row[more], low[more], multi[more]


_FOUND = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("same", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("segment", pa.binary()), ("low", pa.int64()), ("multi", pa.bool_())])
_FOUND_DDL = "key long, id long, same long, at long, anchor long, segment binary, low long, multi boolean"


def _found(sent: _Combiner, buf: np.ndarray, sums: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray | None, ids: np.ndarray, same: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each occurrence of a segment, and one with its bytes where the task has not sent them."""
    key = span_hash(sums, start, start + size)
    anchor = key if anchor is None else anchor
    none = lambda n, kind: pa.nulls(n, kind)
    for z in range(0, len(key), 50_000):
        z = slice(z, z + 50_000)
        n = len(key[z])
        yield pa.RecordBatch.from_arrays([pa.array(key[z].view(np.int64)), pa.array(ids[z]), pa.array(same[z]), pa.array(at[z]), *(none(n, f.type) for f in list(_FOUND)[4:])], schema=_FOUND)
        row, low, multi = sent.add(key[z], ids[z])
        if len(row):
            s, c = start[z][row], size[z][row]
            yield pa.RecordBatch.from_arrays([pa.array(key[z][row].view(np.int64)), *(none(len(row), pa.int64()) for _ in range(3)), pa.array(anchor[z][row].view(np.int64)), _blobs(buf[runs(s, c)], c), pa.array(low), pa.array(multi)], schema=_FOUND)


def _segments(length: int, gram: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Combiner()
        for b in batches:
            ids, same, asked = b.column("id").to_numpy(), b.column("same").to_numpy(), b.column("asked").to_pylist()
            for lo, hi, buf, offs in slices(as_strings(b.column("text"))):
                start, number, h = anchors(buf, offs, length, gram)
                if not len(h):
                    continue
                cut = np.searchsorted(start, offs)
                code = (_shard(h, shards).astype(_U) << _U(32)) | (h & _U(0xFFFFFFFF))
                keep = np.zeros(len(h), bool)
                for d in range(hi - lo):
                    if cut[d] < cut[d + 1] and asked[lo + d]:
                        want = np.concatenate([np.frombuffer(x["hashes"], np.uint32).astype(_U) | (_U(x["shard"]) << _U(32)) for x in asked[lo + d]])
                        want.sort()
                        own = code[cut[d] : cut[d + 1]]
                        keep[cut[d] : cut[d + 1]] = want[np.minimum(np.searchsorted(want, own), len(want) - 1)] == own
                some = np.flatnonzero(keep)
                if len(some):
                    doc = np.searchsorted(offs, start[some], "right") - 1
                    yield from _found(sent, buf, prefix_hash(buf, lower=False), start[some], number[some] + length - 1, h[some], ids[lo + doc], same[lo + doc], start[some] - offs[doc])

    return run


def _strings(length: int):
    """Segments as single strings, each its own anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Combiner()
        for b in batches:
            ids, same, at = (b.column(c).to_numpy() for c in ("id", "same", "at"))
            for lo, hi, buf, offs in slices(as_strings(b.column("segment"))):
                number = np.diff(offs) - length + 1
                starts, owner = runs(offs[:-1], number), np.repeat(np.arange(hi - lo), number)
                yield from _found(sent, buf, prefix_hash(buf, lower=False), starts, np.full(len(starts), length), None, ids[lo + owner], same[lo + owner], at[lo + owner] + starts - offs[owner])

    return run


def _least(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "shard"):
            key, low, multi = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "multi"))
            key, first, where = np.unique(key, return_index=True, return_inverse=True)
            least, most = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
            np.minimum.at(least, where, low)
            np.maximum.at(most, where, low)
            several = (np.bincount(where, weights=multi, minlength=len(key)) > 0) | (least != most)
            _, owner, many = np.unique(t.column("anchor").to_numpy()[first], return_inverse=True, return_counts=True)
            col = t.column("segment").combine_chunks()
            alone = (many == 1)[owner]  # an anchor's only segment shares no string with another
            rest = np.flatnonzero(~alone)
            rest = rest[np.argsort(owner[rest], kind="stable")]
            own = col.take(pa.array(first[rest]))
            off = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
            data = np.frombuffer(own.buffers()[2], np.uint8)[off[0] : off[-1]] if len(own) else np.zeros(0, np.uint8)
            off -= off[0]
            got = shard_least(data, off, least[rest], owner[rest], length, block)
            # runs of equal ids in each segment, of which those count that some document is above
            number = np.diff(off) - length + 1
            begin = np.cumsum(number) - number
            new = np.ones(len(got), bool)
            new[1:] = got[1:] != got[:-1]
            new[begin] = True
            at = np.flatnonzero(new)
            row = np.searchsorted(begin, at, "right") - 1
            end = np.append(at[1:], len(got)) - begin[row]
            says = several[rest[row]] | (got[at] < least[rest[row]])
            at, row, end = at[says], row[says], end[says]
            one = np.flatnonzero(alone & several)
            size = pc.binary_length(col).to_numpy()[first[one]] - length + 1
            cols = [np.concatenate(x).astype(np.int64) for x in ((key[one], key[rest[row]]), (np.zeros(len(one), np.int64), at - begin[row]), (size, end), (least[one], got[at]))]
            for a in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in cols], names=["key", "first", "end", "least"])

    return run


# --- documents ------------------------------------------------------------------------------


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, anchor_shard: int = ANCHOR_SHARD, segment_shard: int = SEGMENT_SHARD, block: int = BLOCK, hot: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(spans, copies): byte ranges (id, same, spans) of first copies, and (same, again, first) of all texts.

    Texts are known by two 64-bit hashes and their length; ``first`` is the smallest id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    base = base.withColumn("same", F.xxhash64("text"))
    total = total_bytes(base, "text")
    shards = max(64, -(-total // anchor_shard))
    sent = base.select("same", "text").mapInArrow(tidy(_send(length, gram, shards), HEAP), "shard int, same long, hashes binary")
    told = sent.repartition(tasks(spark, shards), "shard").sortWithinPartitions("shard").mapInArrow(tidy(_shared, HEAP), "same long, shard int, hashes binary")
    told = stored(told, "anchors").groupBy("same").agg(F.collect_list(F.struct("shard", "hashes")).alias("asked"))  # a row for each shard, no longer than the text
    copies = stored(base.groupBy("same", F.xxhash64(F.lit(1), "text").alias("again")).agg(F.min("id").alias("first"), F.count("*").alias("n")), "texts")
    told = told.join(copies, "same").select(F.col("first").alias("id"), F.col("same").alias("t"), "asked")
    asked = base.join(told, "id").where("same = t").select("id", "same", "text", "asked")
    found = stored(asked.mapInArrow(tidy(_segments(length, gram, shards), HEAP), _FOUND_DDL), "segments")
    places, once = found.where("id is not null").select("key", "id", "same", "at"), found.where("low is not null").select("key", "anchor", "segment", "low", "multi")
    many = once.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("anchor")
    many = stored(once.join(many, "anchor", "left_semi").groupBy("anchor", "key").count().groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("anchor"), "hot-anchors")
    if many.limit(1).count():  # their strings are dealt one by one
        crowd = once.join(many, "anchor", "left_semi").groupBy("key").agg(F.first("segment").alias("segment"))
        split = places.withColumn("k", apart("key")).join(crowd.select(apart("key").alias("k"), "segment"), "k").select("segment", "id", "same", "at")
        split = stored(split.mapInArrow(tidy(_strings(length), HEAP), _FOUND_DDL), "strings")
        places = places.join(crowd, "key", "left_anti").union(split.where("id is not null").select("key", "id", "same", "at"))
        once = once.join(many, "anchor", "left_anti").select("key", "anchor", "segment", "low", "multi").union(split.where("low is not null").select("key", "anchor", "segment", "low", "multi"))
    units = max(64, -(-(once.agg(F.sum(F.octet_length("segment"))).first()[0] or 0) // segment_shard))
    dealt = once.select(F.pmod(F.xxhash64("anchor"), F.lit(units)).cast("int").alias("shard"), "anchor", "key", "segment", "low", "multi")
    lows = stored(dealt.repartition(tasks(spark, units), "shard").sortWithinPartitions("shard").mapInArrow(tidy(_least(length, block), HEAP), "key long, first long, end long, least long"), "lows")
    parts = places.select("id", "same", "at", apart("key").alias("k")).join(lows.select(apart("key").alias("k"), "first", "end", "least"), "k").where("least < id")
    spans = parts.groupBy("id", "same").agg(F.collect_list(F.struct((F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("end") + length - 1).alias("end"))).alias("spans"))
    return spans, copies.select("same", "again", "first")


def _cut(length: int, keep_text: bool, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = as_strings(b.column("_text")).cast(pa.binary()).to_pylist(), b.column("_id").to_pylist()
            spans, firsts, eq = b.column("_spans").to_pylist(), b.column("_first").to_pylist(), []
            out = {"n_bytes": [], "n_removed": [], "removed": [], "kept_sha256": []}
            for raw, i, s, f in zip(texts, ids, spans, firsts, strict=True):
                if f is not None and i is not None and f < i:
                    gone = [(0, len(raw))]
                else:
                    gone = merged([(x["start"], x["end"]) for x in s or []])
                at, kept = 0, []
                for a, e in gone:
                    kept.append(raw[at:a])
                    at = e
                left = b"".join([*kept, raw[at:]]) if gone else raw
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(left))
                out["removed"].append([{"start": a, "end": e} for a, e in gone])
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                eq.append(left.decode("utf-8", "ignore") if keep_text else None)
            cols = [pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept_sha256"], pa.string())]
            names = ["n_bytes", "n_removed", "removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(eq, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *cols], names=[*rest, *names])

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = True, **sizes: int) -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed (byte ranges), kept_sha256 and, on request, kept_text.

    Null texts are empty; texts under ``length`` bytes keep all; rows of one id never remove
    from each other; a row without id neither removes nor loses. Ranges may cut a
    character: kept_text leaves its broken bytes out, kept_sha256 is of the exact rest.
    Columns of these names in ``docs`` are replaced.
    """
    made = ["n_bytes", "n_removed", "removed", "kept_sha256", "kept_text"]
    spans, copies = repeated_spans(docs, doc_id=doc_id, text=text, length=length, **sizes)
    rest = [c for c in docs.columns if c not in made]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*rest, F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), F.when(F.octet_length(whole) >= length, F.xxhash64(whole)).alias("_same"), F.xxhash64(F.lit(1), whole).alias("_again"))
    later = rows.select("_id", "_same", "_again").where("_same is not null and _id is not null").withColumn("k", apart("_same")).join(copies.select(apart("same").alias("k"), "again", "first"), "k").where("_again = again and first < _id")
    later = later.select(F.col("_id").alias("id"), F.col("_same").alias("same"), F.col("first").alias("_first"))
    marks = spans.select("id", "same", F.lit(None).cast("long").alias("_first"), F.col("spans").alias("_spans")).unionByName(later, allowMissingColumns=True)
    marks = marks.groupBy("id", "same").agg(F.max("_first").alias("_first"), F.first("_spans", ignorenulls=True).alias("_spans"))
    out = rows.join(marks, (F.col("_id") == F.col("id")) & (F.col("_same") == F.col("same")), "left").drop("id", "same")
    names = [f.name for f in docs.select(*rest).schema]
    kind = docs.select(*rest, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.lit("").alias("kept_sha256"), *([F.lit("").alias("kept_text")] if keep_text else [])).schema
    return out.mapInArrow(tidy(_cut(length, keep_text, names), HEAP), kind)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, and the digest of what stays."""
    out = remove_repeats(docs.select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
