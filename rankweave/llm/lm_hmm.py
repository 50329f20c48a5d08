"""Language-model scoring with a hidden Markov model trained by Baum-Welch on the corpus.

Tokens are lower-cased words and one end per text. The most frequent training words and the
end are emissions of their own, the more the larger the corpus (:func:`own_words`); every other word is emitted as one of four classes
(ASCII or not, ending in a letter or digit or not), and within its class has the smoothed
probability (c + 1) / (C + V + 1). So the model is a distribution over all texts, and the
scaled forward recursion over a whole text gives its exact probability.

Corpus counts are exact: batches count their words, the counts are summed by hash bucket in
packed arrays, and the rare words of each text go to their bucket and come back as sums.
Baum-Welch runs over all training texts, each as a whole; each task adds up its expected counts and sends
one array per block of words, which are summed by block. What reaches the driver is of the
model's size, and what every task receives too; the counts of all other words stay dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import ALNUM, NON_SPACE, as_strings, groups, mix, partitions, prefix_hash, seeds, slices, small_batches, span_hash, stored, tasks, tidy, total_bytes, word_spans

#: Words with an emission of their own: at OWN_BYTES of text and below, and at most, which bounds the model that every task holds.
TOP, MOST_WORDS = 16_000, 2_000_000
OWN_BYTES = 512 << 20
STATES = 8
ROUNDS = 6
#: Tokens whose messages are held at once; longer stretches keep one message a text at their borders.
HELD = 800_000
CLASSES = 4
#: Text bytes for each bucket of the word counts.
BUCKET_BYTES = 10 << 20
_BLOCK = 2048
#: Rows whose products are summed in the messages' precision.
_ROWS = 8192
_U = np.uint64


def own_words(total: int) -> int:
    """Words with an emission of their own for so many bytes of text: as the distinct words do, they grow with the square root."""
    return min(MOST_WORDS, max(TOP, int(TOP * (total / OWN_BYTES) ** 0.5)))


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, whose two low bits are the word's class, and each text's bounds."""
    starts, ends, ptr = word_spans(buf, offs, NON_SPACE)
    if not len(starts):
        return np.zeros(0, _U), ptr
    high = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf >= 128, out=high[1:])
    kind = (high[ends] > high[starts]).astype(_U) * _U(2) + (~ALNUM[buf[ends - 1]]).astype(_U)
    return (span_hash(prefix_hash(buf), starts, ends) & ~_U(3)) | kind, ptr


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> _U(40)) * _U(n)) >> _U(24)).astype(np.int64)


def _by_bucket(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket and the bounds of the buckets in it."""
    b = _bucket(h, n)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(n + 1))


_COUNTS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("texts", pa.int64())])


def _summed(h: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h_all, c_all = np.concatenate(h), np.concatenate(c)
    u, at = np.unique(h_all, return_inverse=True)
    return u, np.bincount(at, weights=c_all, minlength=len(u)).astype(np.int64)


def _count(n: int, text: str):
    def out(h, c, texts):
        u, k = _summed(h, c)
        cut = np.searchsorted(_bucket(u, n), np.arange(n + 1))
        some = np.flatnonzero((np.diff(cut) > 0) | (np.arange(n) == 0)).tolist()  # the first bucket counts the texts
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([u[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), pa.array([k[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), pa.array([texts] + [0] * (len(some) - 1), pa.int64())], schema=_COUNTS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, texts, held = [], [], 0, 0
        for b in batches:
            for lo, hi, buf, offs in slices(b.column(text)):
                u, k = np.unique(tokens(buf, offs)[0], return_counts=True)
                h.append(u)
                c.append(k)
                texts += hi - lo
                held += len(u)
                if held > 2_000_000:  # hand on what is counted so far
                    yield out(h, c, texts)
                    h, c, texts, held = [], [], 0, 0
        if h:
            yield out(h, c, texts)

    return run


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of the partition: its sorted words, their counts, and the texts."""
    have: dict[int, list] = {}
    for b in batches:
        for k, h, c, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
            own = have.setdefault(k, [[], [], 0, 0])
            own[0].append(np.frombuffer(h, _U))
            own[1].append(np.frombuffer(c, np.int64))
            own[2] += t
            own[3] += len(h) // 8
            if own[3] > 2_000_000:
                u, s = _summed(own[0], own[1])
                have[k] = [[u], [s], own[2], 0]
    for k, (h, c, t, _) in have.items():
        u, s = _summed(h, c)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([u.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary()), pa.array([t], pa.int64())], schema=_COUNTS)


_BINS = 512


def _bin(counts: np.ndarray) -> np.ndarray:
    return (np.log2(counts) * 8).astype(np.int64)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: its texts, tokens and words by class, and words by bin of their count."""
    for b in batches:
        for h, c, t in zip(*(b.column(x).to_pylist() for x in ("hashes", "counts", "texts")), strict=True):
            k = np.frombuffer(c, np.int64)
            kind = (np.frombuffer(h, _U) & _U(3)).astype(np.int64)
            totals = [t, *np.bincount(kind, weights=k, minlength=CLASSES).astype(int).tolist(), *np.bincount(kind, minlength=CLASSES).tolist(), *np.bincount(_bin(k), minlength=_BINS).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([totals], pa.list_(pa.int64()))], names=["totals"])


def _frequent(least: int):
    """Each bucket's words whose count is in bin ``least`` or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(*(b.column(x).to_pylist() for x in ("hashes", "counts")), strict=True):
                u, k = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                keep = _bin(k) >= least
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(k[keep])], names=["word", "n"])

    return run


class Model:
    """Start, transition and emission probabilities, and the words with an emission of their own."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, texts: int, totals: np.ndarray, distinct: np.ndarray, states: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        kind = (self.words & _U(3)).astype(np.int64)
        k = len(words)
        self.k, self.end, self.states = k, k + CLASSES, states
        rare = totals - np.bincount(kind, weights=self.counts, minlength=CLASSES)
        self.rare_size = rare + (distinct - np.bincount(kind, minlength=CLASSES)) + 1  # C + V + 1 of each class
        self.texts = texts
        self.n = int(totals.sum() + texts)
        self.v = int(distinct.sum() + (texts > 0))
        unigram = np.concatenate([self.counts, np.maximum(rare, 0), [texts]]) + 1.0
        self.unigram = unigram / unigram.sum()
        noise = (mix(np.arange(states * (k + CLASSES + 1), dtype=_U) + seeds(1, 3)[0]) >> _U(11)).astype(float).reshape(states, -1) / 2.0**53
        emit = self.unigram * (0.25 + 1.5 * noise)
        self.emit = emit / emit.sum(1, keepdims=True)
        self.trans = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.trans, 0.9 if states > 1 else 1.0)
        self.start = np.full(states, 1.0 / states)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The emission of each word hash."""
        if not self.k:
            return (h & _U(3)).astype(self.kind)
        at = np.minimum(np.searchsorted(self.words, h), self.k - 1)
        return np.where(self.words[at] == h, at, self.k + (h & _U(3)).astype(np.int64)).astype(self.kind)

    @property
    def kind(self) -> type:
        """What an emission's number takes."""
        return np.uint16 if self.end < 1 << 16 else np.uint32

    def update(self, emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> None:
        emit = emit + 50.0 * self.unigram  # a Dirichlet prior: no emission gets probability 0
        self.emit = emit / emit.sum(1, keepdims=True)
        trans = trans + 1.0
        self.trans = trans / trans.sum(1, keepdims=True)
        start = start + 1.0
        self.start = start / start.sum()

    def forward(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Natural log probability of each sequence ids[ptr[i]:ptr[i+1]], by the scaled recursion."""
        order, first, live, done, cuts = _side_by_side(ptr)
        total, table, ones, before = np.zeros(len(order)), np.ascontiguousarray(self.emit.T), np.ones(self.states), None
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            who, token, off = _stretch(ids, first, live, done, lo, hi)
            alpha, scale = table[token], np.empty(len(token))
            for x, y in zip(off[:-1], off[1:], strict=True):
                a = alpha[x:y]
                a *= self.start if before is None else before[: y - x] @ self.trans
                a /= np.matmul(a, ones, out=scale[x:y])[:, None]
                before = a
            total += np.bincount(who, weights=np.log(scale), minlength=len(total))
        out = np.empty(len(order))
        out[order] = total
        return out

    def expect(self, ids: np.ndarray, ptr: np.ndarray, kind=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected emissions, transitions and starts over whole texts, messages in ``kind`` and sums in double precision.

        Texts run side by side. The messages of at most about HELD tokens are held at
        once: of earlier steps only those before each stretch, from which it is run again.
        A step makes messages alone; what they add up to is summed by stretch.
        """
        _, first, live, done, cuts = _side_by_side(ptr)
        s, table, step, begin = self.states, np.ascontiguousarray(self.emit.T, kind), self.trans.astype(kind), self.start.astype(kind)
        back_step, ones = np.ascontiguousarray(step.T), np.ones(self.states, kind)
        emit, trans, start = np.zeros((s, self.end + 1)), np.zeros((s, s)), np.zeros(s)
        if len(cuts) < 2:
            return emit, trans, start

        def forward(lo: int, hi: int, before: np.ndarray | None):
            _, token, off = _stretch(ids, first, live, done, lo, hi)
            like = table[token]
            alpha, scale = np.empty_like(like), np.empty(len(like), kind)
            for x, y in zip(off[:-1], off[1:], strict=True):
                a = np.multiply(like[x:y], begin if before is None else before[: y - x] @ step, out=alpha[x:y])
                a /= np.matmul(a, ones, out=scale[x:y])[:, None]
                before = a
            return token, like, alpha, scale, off

        borders: list[np.ndarray | None] = [None]  # the message before each stretch
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            got = forward(lo, hi, borders[-1])
            borders.append(got[2][got[4][-2] :].copy())
        after = np.ones((0, s), kind)  # the backward message from the stretch behind
        for lo, hi, before in zip(cuts[-2::-1], cuts[:0:-1], borders[::-1], strict=True):
            token, back, alpha, scale, off = forward(lo, hi, before)
            back /= scale[:, None]
            beta = np.ones_like(back)
            beta[off[-2] : off[-2] + len(after)] = after
            for k in range(hi - lo - 1, 0, -1):
                x, y = off[k], off[k + 1]
                own = np.multiply(back[x:y], beta[x:y], out=back[x:y])
                np.matmul(own, back_step, out=beta[off[k - 1] : off[k - 1] + y - x])
            back[: off[1]] *= beta[: off[1]]
            if before is not None:
                trans += before[: off[1]].T @ back[: off[1]]
                after = back[: off[1]] @ back_step
            else:
                start += (alpha[: off[1]] * beta[: off[1]]).sum(0)
            last = np.arange(off[1], off[-1]) - np.repeat(live[lo : hi - 1], live[lo + 1 : hi])  # a token's row one step earlier
            for i in range(0, len(last), _ROWS):
                at = last[i : i + _ROWS]
                trans += alpha[at].T @ back[off[1] + i : off[1] + i + len(at)]
            alpha *= beta  # now the posteriors
            for k, own in enumerate(np.ascontiguousarray(alpha.T)):
                emit[k] += np.bincount(token, weights=own, minlength=self.end + 1)
        return emit, trans * self.trans, start


def _side_by_side(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Texts with the longest first: their order and first tokens, how many are longer than each place, tokens before each place, cuts into stretches."""
    n = np.diff(ptr)
    order = np.argsort(-n, kind="stable")
    live = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")
    done = np.concatenate([[0], np.cumsum(live)])
    cuts = [0]
    while cuts[-1] < len(live):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(done, done[cuts[-1]] + HELD, "right")) - 1))
    return order, ptr[:-1][order], live, done, cuts


def _stretch(ids: np.ndarray, first: np.ndarray, live: np.ndarray, done: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Places ``lo`` to ``hi`` of all texts, place by place: each row's text and emission, and the bounds of places."""
    at = np.repeat(np.arange(lo, hi), live[lo:hi])
    who = np.arange(len(at)) - (done[at] - done[lo])
    return who, ids[first[who] + at], (done[lo : hi + 1] - done[lo]).tolist()


def _uid(counter: list[int], n: int) -> np.ndarray:
    """Row numbers that no other task of the job gives; used only once written."""
    ctx = TaskContext.get()
    base = ((ctx.partitionId() if ctx else 0) << 36) + counter[0]
    counter[0] += n
    return np.arange(base, base + n, dtype=np.int64)


_ENCODED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64()), ("bucket", pa.int32()), ("uids", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary())])
_ENCODED_DDL = "uid long, doc_id long, held boolean, ids binary, n_tokens long, known long, base double, inner double, bucket int, uids binary, sizes binary, hashes binary"


def _encode(model: Model, n: int):
    """Of each text its emissions and what frequent words add; of each batch its rare words by bucket."""
    denominator = np.log10(float(model.n + model.v + 1))
    weight = np.concatenate([np.log10(model.counts + 1.0) - denominator, np.full(CLASSES, -denominator), [np.log10(model.texts + 1.0) - denominator]])
    inner = np.concatenate([np.zeros(model.k), -np.log10(model.rare_size), [0.0]])
    known = np.concatenate([np.ones(model.k, np.int64), np.zeros(CLASSES, np.int64), [int(model.texts > 0)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = [0]
        for b in batches:
            ids_out, lens, sums = [], [], []
            rare_h, rare_u = [], []
            uid = _uid(counter, b.num_rows)
            for lo, hi, buf, offs in slices(as_strings(b.column("text"))):
                h, ptr = tokens(buf, offs)
                ids = model.ids(h)
                rare = np.flatnonzero(ids >= model.k)
                rare_h.append(h[rare])
                rare_u.append(uid[lo:hi][np.searchsorted(ptr, rare, "right") - 1])
                ptr2 = ptr + np.arange(len(ptr))
                full = np.empty(int(ptr2[-1]), model.kind)
                ends = ptr2[1:] - 1
                is_end = np.zeros(len(full), bool)
                is_end[ends] = True
                full[is_end], full[~is_end] = model.end, ids
                ids_out += [full[x:y].tobytes() for x, y in zip(ptr2[:-1], ptr2[1:], strict=True)]
                lens.append(np.diff(ptr2))
                sums.append([np.add.reduceat(x[full], ptr2[:-1]) for x in (known, weight, inner)])
            none = [None] * b.num_rows
            if b.num_rows:
                cols = [uid, b.column("doc_id"), b.column("held"), pa.array(ids_out, pa.binary()), np.concatenate(lens), *(np.concatenate([s[i] for s in sums]) for i in range(3)), none, none, none, none]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _ENCODED, strict=True)], schema=_ENCODED)
            h = np.concatenate(rare_h) if rare_h else np.zeros(0, _U)
            if len(h):
                u = np.concatenate(rare_u)
                order, cut = _by_bucket(h, n)
                h, u = h[order], u[order]
                rows = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    own, sizes = np.unique(u[cut[k] : cut[k + 1]], return_counts=True)
                    rows.append((k, own.tobytes(), sizes.astype(np.int32).tobytes(), h[cut[k] : cut[k + 1]].tobytes()))
                cols = [[int(uid[0])] * len(rows)] + [[None] * len(rows)] * 7 + [list(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENCODED, strict=True)], schema=_ENCODED)

    return run


def _ids(b: pa.RecordBatch, kind: type, limit: int = HELD) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    width = np.dtype(kind).itemsize
    for lo, hi, buf, offs in slices(b.column("ids"), width * limit):
        yield lo, hi, np.ascontiguousarray(buf).view(kind), offs // width


def _expectations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, trans, start = np.zeros_like(model.emit), np.zeros_like(model.trans), np.zeros_like(model.start)
        for b in batches:
            for _, _, ids, ptr in _ids(b, model.kind):
                e, t, s = model.expect(ids, ptr, np.float32)
                emit += e
                trans += t
                start += s
        rows = [(-1, np.concatenate([trans.ravel(), start]).tobytes())] + [(i, emit[:, i : i + _BLOCK].tobytes()) for i in range(0, emit.shape[1], _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "sums"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(v)
            have[k] = have[k] + x if k in have else x
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.tobytes() for v in have.values()], pa.binary())], names=["block", "sums"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by text of a bucket's rare words, packed by the batch of texts; the bucket's counts come before its words."""
    now, words, counts = None, np.zeros(0, _U), np.zeros(0, np.int64)
    for b in batches:
        for k, batch, uids, sizes, hashes, c in zip(*(b.column(x).to_pylist() for x in ("bucket", "uid", "uids", "sizes", "hashes", "counts")), strict=True):
            if k != now:
                now, words, counts = k, np.zeros(0, _U), np.zeros(0, np.int64)
            if c is not None:
                words, counts = np.frombuffer(hashes, _U), np.frombuffer(c, np.int64)
                continue
            h, n = np.frombuffer(hashes, _U), np.frombuffer(sizes, np.int32)
            found = np.zeros(len(h), np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                found = np.where(words[at] == h, counts[at], 0)
            first = np.cumsum(n) - n
            more, logs = np.add.reduceat((found > 0).astype(np.int64), first), np.add.reduceat(np.log10(found + 1.0), first)
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), *(pa.array([x], pa.binary()) for x in (uids, more.tobytes(), logs.tobytes()))], names=["uid", "uids", "more", "logs"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text: the sums of its batch's answers from all buckets."""
    for _, t in groups(batches, "uid"):
        uids, more, logs = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("uids", np.int64), ("more", np.int64), ("logs", np.float64)))
        own, at = np.unique(uids, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, weights=more).astype(np.int64)), pa.array(np.bincount(at, weights=logs))], names=["uid", "more", "logs"])


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ll = np.concatenate([model.forward(ids, ptr) for _, _, ids, ptr in _ids(b, model.kind)]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "doc_id", "held", "n_tokens", "known", "base", "inner")), pa.array(ll)], names=["uid", "doc_id", "held", "n_tokens", "known", "base", "inner", "ll"])

    return run


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out=None, top: int | None = None, states: int = STATES, rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column of the texts that are scored but not learnt from. Null and
    empty texts are one end token; repeated rows are texts of their own; without training texts
    every count is 0; no rows give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), held.alias("held"))
    train = df.where("not held").select("text")
    total = total_bytes(df, "text")
    n, top = max(8, -(-total // bucket_bytes)), own_words(total) if top is None else top
    kind = "bucket int, hashes binary, counts binary, texts long"
    counts = stored(train.mapInArrow(tidy(_count(n, "text")), kind).repartition(tasks(spark, n), "bucket").mapInArrow(tidy(_merge_counts), kind), "lm-counts")
    facts = counts.mapInArrow(tidy(_facts), "totals array<long>")
    sums = facts.select([F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(1 + 2 * CLASSES + _BINS)]).first()
    sums, bins = np.split(np.array([x or 0 for x in sums], np.int64), [1 + 2 * CLASSES])
    above = np.cumsum(bins[::-1])[::-1]  # words by bin and above
    least = int(np.flatnonzero(above >= min(top, above[0])).max())
    most = counts.mapInArrow(tidy(_frequent(least)), "word long, n long").orderBy(F.desc("n"), "word").limit(top).select("word", "n").collect()  # of the model's size
    model = Model(np.array([r.word for r in most], np.int64).view(_U), np.array([r.n for r in most], np.int64), int(sums[0]), sums[1 : 1 + CLASSES], sums[1 + CLASSES :], states)
    coded = stored(df.mapInArrow(tidy(_encode(model, n)), _ENCODED_DDL), "lm-coded")
    texts = coded.where("bucket is null")
    learn = texts.where("not held").select("ids")
    for _ in range(rounds if sums[0] else 0):
        rows = learn.mapInArrow(tidy(_expectations(model)), "block int, sums binary").repartition(partitions(spark), "block").mapInArrow(tidy(_add_blocks), "block int, sums binary").collect()
        if not rows:
            break
        got = {r.block: np.frombuffer(r["sums"]) for r in rows}
        emit = np.concatenate([got[i].reshape(states, -1) for i in sorted(got) if i >= 0], axis=1)
        model.update(emit, got[-1][: states**2].reshape(states, states), got[-1][states**2 :])
    asked = coded.where("bucket is not null").select("bucket", "uid", "uids", "sizes", "hashes", F.lit(None).cast("binary").alias("counts"), F.lit(1).alias("turn"))
    known = counts.select("bucket", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("binary").alias("uids"), F.lit(None).cast("binary").alias("sizes"), "hashes", "counts", F.lit(0).alias("turn"))
    answers = known.union(asked).repartition(tasks(spark, n), "bucket").sortWithinPartitions("bucket", "turn").mapInArrow(tidy(_answer), "uid long, uids binary, more binary, logs binary")
    answers = answers.repartition(tasks(spark, n), "uid").sortWithinPartitions("uid").mapInArrow(tidy(_added), "uid long, more long, logs double")
    scored = texts.select("uid", "doc_id", "held", "ids", "n_tokens", "known", "base", "inner").mapInArrow(tidy(_scores(model)), "uid long, doc_id long, held boolean, n_tokens long, known long, base double, inner double, ll double")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.join(answers, "uid", "left").select("doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("ll") + F.col("inner") + logs).alias("score"))


def scoring_digest(docs: DataFrame) -> DataFrame:
    """All documents' scores, learnt from those whose id's checksum is not 2 modulo 7."""
    return score(docs, held_out=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
