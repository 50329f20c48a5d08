"""Repetition coverage: what part of a text's characters lies in repeated n-grams and lines.

Words are hashed once; a running sum of their hashes gives the hash of every window of n words
for any n by one subtraction, so several lengths cost little more than one. A window that stands
twice in its text covers all of its words. A longer window can only repeat where both windows
inside it do, so each length looks at what the one before has left. Lines are known by the hash
of their bytes.

A document is judged by itself: there is no shuffle, and a task holds one slice of texts. The
hashes have 64 bits and are compared within a text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import NON_SPACE, mix, prefix_hash, running, slices, small_batches, span_hash, tidy, window_hash, word_spans

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Lengths of the n-grams in words; the first is the one whose words are counted.
LENGTHS = (5, 6, 8, 10)
#: Shares of the characters of all words, by length, above which a text is refused, and that of repeated lines.
SHARES = (0.30, 0.30, 0.28, 0.25)
LINE_SHARE = 0.30
LEAST_WORDS, BASE_PERCENT = 10, 20
_U = np.uint64
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _again(keys: np.ndarray, first: bool) -> np.ndarray:
    """Which keys stand twice or more (with ``first``), or are equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = same[:-1] | same[1:] if first else same[:-1]
    return out


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``n`` that starts in ``at``."""
    steps = np.bincount(at, minlength=size + n) - np.bincount(at + n, minlength=size + n)
    return np.cumsum(steps[:size]) > 0


def measures(buf: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> dict[str, np.ndarray]:
    """Per text of ``buf`` (see :func:`textcore.word_spans`) its counts; ``chars`` and ``words`` have a column for each length."""
    n_docs = len(offs) - 1
    starts, ends, ptr = word_spans(buf, offs, NON_SPACE)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    size = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])  # code points in the words before
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[buf])])
    doc = np.repeat(np.arange(n_docs), np.diff(ptr))
    prefix = prefix_hash(buf, lower=False)
    sums = running(span_hash(prefix, starts, ends))
    salt = mix(np.arange(1, n_docs + 1, dtype=_U))
    words, chars = np.zeros((n_docs, len(lengths)), np.int64), np.zeros((n_docs, len(lengths)), np.int64)
    open_, last = np.arange(len(starts)), 0
    for j, n in enumerate(lengths):
        if last:  # both windows of the last length at either end have to repeat
            again = np.zeros(len(starts) + n, bool)
            again[open_] = True
            open_ = open_[again[open_ + n - last]]
        open_ = open_[open_ + n <= len(starts)]
        open_ = open_[doc[open_] == doc[open_ + n - 1]] if len(open_) else open_
        if len(open_):
            keys = window_hash(sums, open_, n) ^ salt[doc[open_]]
            open_ = open_[_again(keys, True)]
        inside = _covered(open_, n, len(starts)) if len(open_) else np.zeros(len(starts), bool)
        words[:, j] = np.bincount(doc[inside], minlength=n_docs)
        chars[:, j] = np.bincount(doc[inside], weights=np.diff(size)[inside], minlength=n_docs)
        last = n
    # lines: from a text's start or a line feed to the next line feed or the text's end
    feeds = np.flatnonzero(buf == 10)
    of = np.searchsorted(offs, feeds, "right") - 1
    low = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n_docs), of]), kind="stable")
    high = np.concatenate([low[1:], offs[-1:]])
    high = high - (np.diff(line_doc, append=n_docs) == 0)  # without the line feed
    w0, w1 = np.searchsorted(starts, low), np.searchsorted(starts, high)
    some = np.flatnonzero(w1 > w0)
    twice = some[_again(span_hash(prefix, low[some], high[some]) ^ salt[line_doc[some]], False)] if len(some) else some
    dup = np.bincount(line_doc[twice], minlength=n_docs)
    line_chars = np.bincount(line_doc[twice], weights=size[w1[twice]] - size[w0[twice]], minlength=n_docs)
    return {
        "n_words": np.diff(ptr), "word_chars": size[ptr[1:]] - size[ptr[:-1]], "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
        "n_dup_lines": dup, "dup_line_chars": line_chars.astype(np.int64), "words": words, "chars": chars,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars")


def repetition(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, dup_line_chars, and by
    length ``gram_words`` and ``gram_chars``, the words and their code points inside repeated n-grams.

    A null or empty text has none of anything; repeated rows are documents of their own; a line without a
    word does not count; other columns are not looked at, whatever their names; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    if list(lengths) != sorted(set(lengths)) or not lengths or lengths[0] < 1:
        raise ValueError("lengths must rise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in slices(b.column("text")):
                m = measures(buf, offs, lengths)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(m[c].ravel()), len(lengths)).cast(pa.list_(pa.int64())) for c in ("words", "chars")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(m[c].astype(np.int64)) for c in _COUNTS), *lists], names=["doc_id", *_COUNTS, "gram_words", "gram_chars"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", gram_words array<long>, gram_chars array<long>")


def repetitive(shares: tuple[float, ...] = SHARES, line_share: float = LINE_SHARE) -> Column:
    """Whether a row of :func:`repetition` has more of its words' characters in repeats than allowed."""
    over = F.col("dup_line_chars") > F.lit(line_share) * F.col("word_chars")
    for j, most in enumerate(shares):
        over = over | (F.col("gram_chars")[j] > F.lit(most) * F.col("word_chars"))
    return over


def quality_digest(docs: DataFrame) -> DataFrame:
    """The counts and verdicts of all documents by the default lengths and shares."""
    repeats = F.col("gram_words")[0]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * repeats > BASE_PERCENT * F.col("n_words"))
    rows = repetition(docs).withColumn("base_failed", failed)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "base_failed", (~F.col("base_failed") & ~repetitive()).alias("kept"),
        "dup_line_chars", F.col("gram_chars")[0].alias("repeat_chars"), F.col("gram_chars")[len(LENGTHS) - 1].alias("long_repeat_chars"),
    )
