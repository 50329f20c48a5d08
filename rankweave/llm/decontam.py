"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds the normalised words of every item. Training texts stream past it; at
each word it knows the longest match ending there, so every window of ``window`` item words
(or a whole shorter item) is found wherever it occurs. Two filters come first: short n-grams
of the items, hashed, tell which stretches of a text can hold a window at all (each n-gram of
a window is an item n-gram, so nothing is lost), and only those stretches reach the automaton,
which compares the words themselves.

One scan, no shuffle. An automaton holds ``shard_bytes`` of item text, is built in a task and
kept in flat arrays, some 25 bytes for each of text (6 as it is sent); a larger benchmark is dealt by id
into several automata that pass over the texts one after another, each adding its hits to
those found before.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import ALNUM, HashSet, hash_bytes, ngram_hash, prefix_hash, slices, small_batches, span_hash, tidy, total_bytes, word_spans

WINDOW = 13
#: Bytes of benchmark text in one automaton.
SHARD_BYTES = 4 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of letters, digits and non-ASCII characters."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """Of several word sequences; a state knows its items and the whole items that end in it.

    States are numbers in flat arrays. Most have a single way on, kept as a word and a state;
    only those that branch have a dictionary. Items by state are sorted pairs.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.names = window, {}
        self.word, self.to = array("i", [-1]), array("i", [-1])  # the single way on
        self.branches: dict[int, dict[int, int]] = {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        self.ids = [i for i, _ in items]
        coded = [[self.names.setdefault(w, len(self.names)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for w in words:
                last = self._add(last, w)
        state, item, marked = array("i"), array("i"), array("i", [-1]) * len(self.link)
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(coded):
            at = 0
            for w in words:
                at = up = self._next(at, w)
                while up > 0 and self.len[up] >= window and marked[up] != k:
                    marked[up] = k
                    state.append(up)
                    item.append(k)
                    up = self.link[up]
            if 0 < len(words) < window:
                self.whole.setdefault(at, []).append((len(words), k))
        state, item = np.array(state, np.int32), np.array(item, np.int32)
        order = np.argsort(state, kind="stable")
        self.state, self.item = state[order], item[order]

    def _next(self, at: int, w: int) -> int:
        if self.word[at] == w:
            return self.to[at]
        return self.branches[at].get(w, -1) if at in self.branches else -1

    def _set(self, at: int, w: int, to: int) -> None:
        if self.word[at] == -1 or self.word[at] == w:
            self.word[at], self.to[at] = w, to
        else:
            self.branches.setdefault(at, {})[w] = to

    def _new(self, length: int, link: int) -> int:
        for x, v in ((self.word, -1), (self.to, -1), (self.link, link), (self.len, length)):
            x.append(v)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.branches:
            self.branches[clone] = dict(self.branches[q])
        self.link[q] = clone
        while p >= 0 and self._next(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        q = self._next(last, w)
        if q >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        cur = self._new(self.len[last] + 1, 0)
        p = last
        while p >= 0 and self._next(p, w) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, w)
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return cur

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(first word, end word, item) of each window occurrence in ``words``."""
        state, length, window = 0, 0, self.window
        for i, name in enumerate(words, 1):
            w = self.names.get(name, -2)
            while state and self._next(state, w) < 0:
                state = self.link[state]
                length = self.len[state]
            to = self._next(state, w)
            if to < 0:
                continue
            state, length = to, length + 1
            if length >= window:
                s = state
                while self.len[self.link[s]] >= window:
                    s = self.link[s]
                for k in self.item[np.searchsorted(self.state, s) : np.searchsorted(self.state, s, "right")].tolist():
                    yield i - window, i, k
            s = state
            while s > 0 and self.whole:
                for n, k in self.whole.get(s, ()):
                    if n <= length:
                        yield i - n, i, k
                s = self.link[s]


class Matcher:
    """The automaton of some items behind the n-gram filter."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        items = [(i, w) for i, w in items if w]
        shortest = min((len(w) for _, w in items), default=window)
        self.n = min(4, shortest)
        self.need = min(window, shortest)
        self.automaton = SuffixAutomaton(items, window)
        grams = [ngram_hash(np.array([hash_bytes(x) for x in w], np.uint64), self.n) for _, w in items]
        self.grams = HashSet(np.concatenate(grams) if grams else np.zeros(0, np.uint64))

    def find(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[tuple[int, int, int]]]]:
        """Word starts, ends and bounds by document, and the occurrences by document."""
        starts, ends, ptr = word_spans(buf, offs, ALNUM)
        found: dict[int, list[tuple[int, int, int]]] = {}
        if len(starts) < self.need or not len(self.grams.values):
            return starts, ends, ptr, found
        at, _ = self.grams.index(ngram_hash(span_hash(prefix_hash(buf), starts, ends), self.n))
        if not len(at):
            return starts, ends, ptr, found
        doc = np.searchsorted(ptr, at, "right") - 1
        inside = at + self.n <= ptr[doc + 1]
        at, doc = at[inside], doc[inside]
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(at)], strict=True):
            if hi - lo + self.n - 1 < self.need:
                continue
            first, end, d = int(at[lo]), int(at[hi - 1]) + self.n, int(doc[lo])
            words = [bytes(buf[starts[i] : ends[i]]).lower() for i in range(first, end)]
            hits = [(first + a - int(ptr[d]), first + b - int(ptr[d]), k) for a, b, k in self.automaton.matches(words)]
            if hits:
                found.setdefault(d, []).extend(hits)
        return starts, ends, ptr, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _built(window: int):
    """The pickled matcher of a shard's items, ``shard_bytes`` of text in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(i, words_of(t)) for b in batches for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Matcher(items, window), pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["matcher"])

    return run


_SPANS = pa.list_(pa.struct([("word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _pass(matcher: Matcher, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, spans, items = [], [], [], []
            old_spans, old_items = b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist()
            for lo, hi, buf, offs in slices(b.column(text)):
                starts, ends, ptr, found = matcher.find(buf, offs)
                n_words += np.diff(ptr).tolist()
                for d in range(hi - lo):
                    before, got = old_spans[lo + d] or [], found.get(d, [])
                    whole = merge([(x["word"], x["end_word"]) for x in before] + [(a, e) for a, e, _ in got])
                    spans.append([{"word": a, "end_word": e, "start": int(starts[ptr[d] + a] - offs[d]), "end": int(ends[ptr[d] + e - 1] - offs[d])} for a, e in whole])
                    items.append(sorted({*(old_items[lo + d] or []), *(str(matcher.automaton.ids[k]) for _, _, k in got if matcher.automaton.ids[k] is not None)}))
                    n_hit.append(sum(e - a for a, e in whole))
            out = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit_spans": pa.array(spans, _SPANS), "hit_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([out.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], names=b.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_share: float = 0.05, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with what the benchmark items contribute to each text.

    Adds n_words, n_hit (words inside any window occurrence), hit_spans (maximal hit runs as
    word and UTF-8 byte ranges), hit_items (ids as strings, sorted), and contaminated: hits
    cover at least ``max_share`` of the words. Columns of these names in ``docs`` are replaced.

    A null or empty text has no words and no hits; an item without words has no window;
    repeated items and item ids count once; an item of null id marks its words but is not in
    hit_items; an empty benchmark leaves every text clean.
    """
    small_batches(docs.sparkSession)
    made = ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated"]
    spans = "array<struct<word:int,end_word:int,start:int,end:int>>"
    df = docs.drop(*made).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(spans).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    shards = max(1, -(-total_bytes(items, "t") // shard_bytes))
    for s in range(shards):
        part = items.where(F.pmod(F.xxhash64(F.coalesce("i", "t"), "t"), F.lit(shards)) == s)
        made = part.repartition(1).sortWithinPartitions("i", "t").mapInArrow(tidy(_built(window)), "matcher binary").first()
        df = df.mapInArrow(tidy(_pass(pickle.loads(made[0]) if made else Matcher([], window), text)), df.schema)
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(max_share) * F.col("n_words")))


def remove_spans(judged: DataFrame, *, text: str = "text", min_words: int = WINDOW, max_share: float = 0.05) -> DataFrame:
    """Cut hit spans of ``min_words`` words or more; drop rows whose hits exceed ``max_share``.

    Takes the result of :func:`decontaminate`. The coverage limit is judged on the whole text.
    """
    kind = judged.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(text).to_pylist(), []
            for t, spans in zip(texts, b.column("hit_spans").to_pylist(), strict=True):
                cut = [(x["start"], x["end"]) for x in spans or [] if x["end_word"] - x["word"] >= min_words]
                if cut:
                    raw, at, kept = t.encode(), 0, []
                    for a, e in cut:
                        kept.append(raw[at:a])
                        at = e
                    t = b"".join([*kept, raw[at:]]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(i).type) if f.name == text else b.column(i) for i, f in enumerate(b.schema)], names=b.schema.names)

    return judged.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.lit(max_share) * F.col("n_words"))).mapInArrow(tidy(run), kind)


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, the items' digest, and the verdict at one word in twenty."""
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
