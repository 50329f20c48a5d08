"""Toxicity with a linear-chain conditional random field over words.

Labels stand on documents, so the words of a bounded sample of labelled texts are labelled
first: in a toxic text, a word is toxic if it or one of its prefixes is found in toxic texts far
more often than chance allows. From these labelled words a two-state field learns weights for
words and prefixes and for the steps between states. Forward-backward then gives each word's
marginal; their sum, maximum and share in a text feed a logistic score fitted on the same
sample's document labels.

Words without any weighted feature share one potential matrix, so a stretch of them is a matrix
power and the recursion is exact over the whole text while visiting only the other words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import ALNUM, HashSet, as_strings, mix, prefix_hash, slices, small_batches, span_hash, stored, tidy, word_spans

#: Labelled texts of each class that the classifier is fitted on, at most.
SAMPLE = 2_500
PREFIXES = (3, 4, 5, 6)
MIN_TEXTS = 4
ROUNDS = 80
THRESHOLD = 0.7
_U = np.uint64


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word starts, ends, bounds by text, whole-word hashes, and hashes of their prefixes (0: the word is no longer)."""
    starts, ends, ptr = word_spans(buf, offs, ALNUM)
    if not len(starts):
        return starts, ends, ptr, np.zeros(0, _U), [np.zeros(0, _U)] * len(PREFIXES)
    sums = prefix_hash(buf)
    short = [np.where(ends - starts > k, mix(span_hash(sums, starts, np.minimum(starts + k, ends)) + _U(k)), _U(0)) for k in PREFIXES]
    return starts, ends, ptr, span_hash(sums, starts, ends), short


def feature_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row of ``texts``, its words' feature hashes) one text after another."""
    for lo, hi, buf, offs in slices(texts):
        _, _, ptr, whole, short = features(buf, offs)
        for d in range(lo, hi):
            a, b = ptr[d - lo], ptr[d - lo + 1]
            yield d, np.stack([whole[a:b], *(s[a:b] for s in short)], axis=1)


class Association:
    """In how many toxic and other texts the features of toxic ones are found; toxic texts come first.

    Only hashes of toxic texts are held, so the others may be any number.
    """

    HELD = 2_000_000

    def __init__(self) -> None:
        self.hashes, self.counts = np.zeros(0, _U), np.zeros((2, 0), np.int64)
        self.texts, self.held, self.parts = [0, 0], 0, []

    def add(self, toxic: bool, rows: np.ndarray) -> None:
        self.texts[toxic] += 1
        u = np.unique(rows)
        u = u[u > 0]
        if toxic:
            self.parts.append(u)
            self.held += len(u)
            if self.held > self.HELD:
                self._merge()
            return
        self._merge()
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, u), len(self.hashes) - 1)
            self.counts[0, at[self.hashes[at] == u]] += 1

    def _merge(self) -> None:
        if self.parts:
            u, n = np.unique(np.concatenate(self.parts), return_counts=True)
            names = np.union1d(self.hashes, u)
            counts = np.zeros((2, len(names)), np.int64)
            counts[:, np.searchsorted(names, self.hashes)] = self.counts
            counts[1, np.searchsorted(names, u)] += n
            self.hashes, self.counts, self.parts, self.held = names, counts, [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that may carry weight (the rest share the background), and whether they mark a word as toxic."""
        self._merge()
        other, bad = self.counts
        odds = np.log((bad + 0.5) / (self.texts[1] + 1)) - np.log((other + 0.5) / (self.texts[0] + 1))
        surely = odds - 1.64 * np.sqrt(1 / (bad + 0.5) + 1 / (other + 0.5))
        keep = (bad >= MIN_TEXTS) & (surely > 0.5)
        return self.hashes[keep], (surely[keep] > 1.0) & (odds[keep] > 2.5)


def _powers(base: np.ndarray, slopes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """base ** n and its derivatives along ``slopes``, both over one positive scale for each n."""
    out, d_out = np.tile(np.eye(2), (len(n), 1, 1)), np.zeros((len(n), len(slopes), 2, 2))
    while n.any():
        odd = (n & 1).astype(bool)
        d_out[odd] = d_out[odd] @ base + out[odd][:, None] @ slopes
        out[odd] = out[odd] @ base
        scale = out.sum((1, 2))
        out, d_out = out / scale[:, None, None], d_out / scale[:, None, None, None]
        slopes, base = slopes @ base + base @ slopes, base @ base
        slopes, base = slopes / base.sum(), base / base.sum()
        n = n >> 1
    return out, d_out


class Chains:
    """Whole texts as the chains of their weighted words, side by side, the longest first."""

    def __init__(self, texts: list[tuple[int, np.ndarray, np.ndarray]], toxic: np.ndarray, marks: np.ndarray):
        """texts: (words, places of weighted words, their features), as :meth:`Field.look` gives them."""
        own = [np.unique(w, return_inverse=True) for _, w, _ in texts]
        k = np.array([len(u) for u, _ in own], np.int64)
        order = np.argsort(-k, kind="stable")
        self.k, self.words = k[order], np.array([n for n, _, _ in texts], np.int64)[order]
        self.live = np.searchsorted(-self.k, -np.arange(int(k.max(initial=0))), "left")
        first = np.cumsum(self.live) - self.live
        self.off = [*first.tolist(), int(k.sum())]
        place, cell, feat = np.empty(int(k.sum()), np.int64), [], []
        self.y = np.zeros(int(k.sum()))
        for r, d in enumerate(order.tolist()):
            (u, inverse), f = own[d], texts[d][2]
            at = first[: len(u)] + r
            place[at] = u
            cell.append(at[inverse])
            feat.append(f)
            if toxic[d]:
                self.y[at[inverse[marks[f]]]] = 1.0
        self.cell, self.feat = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (cell, feat))
        self.gap = place.copy()  # background words before each weighted word, and after the last
        for t in range(1, len(self.live)):
            lo, n = self.off[t], self.live[t]
            self.gap[lo : lo + n] = place[lo : lo + n] - place[self.off[t - 1] : self.off[t - 1] + n] - 1
        some = self.k > 0
        last = first[np.maximum(self.k, 1) - 1] + np.arange(len(self.k)) if len(place) else np.zeros(0, np.int64)
        self.rest = self.words[some] - 1 - place[last[some]] if len(place) else np.zeros(0, np.int64)
        self.bare = self.words[~some]
        self.bare = self.bare[self.bare > 0]
        # steps between the labelled states, of all words
        after = np.zeros(len(place))
        after[last[some]] = self.rest == 0
        one, end, begin = self.y.sum(), (self.y * after).sum(), (self.y[: self.off[1] if len(self.live) else 0] * (self.gap[: self.off[1] if len(self.live) else 0] == 0)).sum()
        both = sum((self.y[self.off[t] : self.off[t] + n] * self.y[self.off[t - 1] : self.off[t - 1] + n] * (self.gap[self.off[t] : self.off[t] + n] == 0)).sum() for t, n in enumerate(self.live) if t)
        steps = np.maximum(self.words - 1, 0).sum()
        self.seen = np.array([[steps - (one - end) - (one - begin) + both, one - begin - both], [one - end - both, both]])

    def expected(self, e: np.ndarray, bias: float, step: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Marginals of the weighted words, the background's expected toxic words, expected steps."""
        t, back = np.exp(np.clip(step, -10, 10)), np.array([1.0, np.exp(bias)])
        units = np.eye(4).reshape(4, 2, 2) * t  # derivatives of the steps along their logarithms
        d_back = np.array([0.0, back[1]])
        before, after = back[:, None] * t, t * back  # a background word, then a step; a step, then such a word
        d_before = np.concatenate([(d_back[:, None] * t)[None], back[:, None] * units])
        d_after = np.concatenate([(t * d_back)[None], units * back])
        d_t = np.concatenate([np.zeros((1, 2, 2)), units])
        lengths, at = np.unique(self.gap, return_inverse=True)
        p, dp = _powers(before, d_before, lengths)
        g, dg = t @ p, d_t @ p[:, None] + t @ dp
        emit = np.stack([np.ones(len(e)), np.exp(np.clip(e, -30, 30))], axis=1)
        alpha, total = np.empty((len(e), 2)), np.zeros(5)
        for i, n in enumerate(self.live.tolist()):
            lo = self.off[i]
            m = (g if i else p)[at[lo : lo + n]]
            a = (m.sum(1) if not i else (alpha[self.off[i - 1] : self.off[i - 1] + n, :, None] * m).sum(1)) * emit[lo : lo + n]
            alpha[lo : lo + n] = a / a.sum(1, keepdims=True)
        p_own = np.empty(len(e))
        beta = np.ones((0, 2))
        if len(self.rest):
            r, at_r = np.unique(self.rest, return_inverse=True)
            q, dq = _powers(after, d_after, r)
            ends = q[at_r].sum(2)  # of each text with weighted words, longest first
            d_ends = dq[at_r].sum(3)
        for i in range(len(self.live) - 1, -1, -1):
            lo, n = self.off[i], int(self.live[i])
            new = slice(len(beta), n)  # texts whose last weighted word this is
            beta = np.concatenate([beta, ends[new]])
            z = (alpha[lo : lo + n] * beta).sum(1)
            p_own[lo : lo + n] = alpha[lo : lo + n, 1] * beta[:, 1] / z
            total += ((d_ends[new] * alpha[lo : lo + n][new][:, None]).sum(2) / z[new][:, None]).sum(0)
            back_in = emit[lo : lo + n] * beta
            m, dm = (g if i else p)[at[lo : lo + n]], (dg if i else dp)[at[lo : lo + n]]
            past = alpha[self.off[i - 1] : self.off[i - 1] + n] if i else np.ones((n, 2))
            norm = (past * (m * back_in[:, None]).sum(2)).sum(1)
            total += ((dm * back_in[:, None, None]).sum(3) * past[:, None]).sum(2).T @ (1 / norm)
            beta = (m * back_in[:, None]).sum(2)
            beta /= beta.sum(1, keepdims=True)
        if len(self.bare):
            n, times = np.unique(self.bare, return_counts=True)
            m, dm = _powers(before, d_before, n - 1)
            z = m.sum(1) @ back
            d = dm.sum(2) @ back
            d[:, 0] += m.sum(1) @ d_back
            total += (d * (times / z)[:, None]).sum(0)
        return p_own, float(total[0]), total[1:].reshape(2, 2)



class Field:
    """Weights of a two-state chain, and the document score on top."""

    def __init__(self) -> None:
        self.known = HashSet(np.zeros(0, _U))
        self.weights = np.zeros(0)
        self.bias = 0.0
        self.step = np.zeros((2, 2))
        self.coef = np.zeros(4)
        self.gaps: dict[int, np.ndarray] = {}

    # --- learning -------------------------------------------------------------------

    def fit(self, texts: list[str], toxic: np.ndarray) -> Field:
        """From whole texts and their labels, all in one process; :func:`fit_toxicity` deals them out."""
        toxic, arr, found = np.asarray(toxic, float), pa.array(texts, pa.large_string()), Association()
        for side in (1, 0):
            for _, rows in feature_rows(arr.filter(pa.array(toxic == side))):
                found.add(bool(side), rows)
        hashes, marks = found.found()
        self.known = HashSet(hashes)
        return self.learn([(len(rows), *self.look(rows)) for _, rows in feature_rows(arr)], toxic, marks)

    def look(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) pairs of the weighted features in rows of hashes."""
        at, rank = self.known.index(rows.ravel())
        return at // rows.shape[1], rank

    def learn(self, texts: list[tuple[int, np.ndarray, np.ndarray]], toxic: np.ndarray, marks: np.ndarray) -> Field:
        """From (words, places, features) of each text; without both classes every score is 0.5."""
        self.coef = np.zeros(4)
        self.weights, self.gaps = np.zeros(len(self.known.values)), {}
        if not 0 < toxic.sum() < len(toxic):
            return self
        if len(self.known.values):
            self._train(Chains(texts, toxic, marks))
        self._score_fit(texts, toxic)
        return self

    def _train(self, chains: Chains) -> None:
        size = len(self.known.values)
        theta, m, v = np.zeros(size + 5), np.zeros(size + 5), np.zeros(size + 5)
        theta[size] = -3.0
        for it in range(1, ROUNDS + 1):
            e = np.bincount(chains.cell, weights=theta[chains.feat], minlength=len(chains.y)) + theta[size]
            p, background, steps = chains.expected(e, theta[size], theta[size + 1 :].reshape(2, 2))
            gap = chains.y - p
            grad = np.concatenate([np.bincount(chains.feat, weights=gap[chains.cell], minlength=size), [gap.sum() - background], (chains.seen - steps).ravel()])
            grad -= np.concatenate([0.05 * theta[:size], [0.0], 0.05 * theta[size + 1 :]])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.15 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
        self.weights, self.bias, self.step = theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)

    def _score_fit(self, texts: list[tuple[int, np.ndarray, np.ndarray]], toxic: np.ndarray) -> None:
        x = np.array([self._summary(self.marginals(*self._emissions(w, f), n)[1], n) for n, w, f in texts])
        beta = np.zeros(4)
        for _ in range(40):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            ridge = np.array([1e-3, 0.05, 0.05, 0.05])
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
            beta = beta + np.linalg.solve(h, x.T @ (toxic - p) - ridge * beta)
        self.coef = beta

    # --- use ----------------------------------------------------------------------------

    def _emissions(self, w: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with weighted features, ascending, and their potentials for state 1."""
        own, at = np.unique(w, return_inverse=True)
        return own, np.bincount(at, weights=self.weights[f], minlength=len(own)) + self.bias if len(own) else np.zeros(0)

    def _gap(self, n: int) -> np.ndarray:
        """The matrix of ``n`` background words and the steps around them, scaled."""
        if n not in self.gaps:
            t = np.exp(np.clip(self.step, -10, 10))
            one = t * np.array([1.0, np.exp(self.bias)])[None, :]  # a step, then a background word
            root = (np.trace(one) + np.sqrt((one[0, 0] - one[1, 1]) ** 2 + 4 * one[0, 1] * one[1, 0])) / 2
            got = np.linalg.matrix_power(one / root, n) @ t
            self.gaps[n] = got / got.sum()
        return self.gaps[n]

    def marginals(self, own: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, marginals of the toxic state) by forward-backward over all ``n`` words."""
        k = len(own)
        if not k:
            return own, np.zeros(0)
        before = np.diff(np.r_[-1, own]) - 1
        back = np.array([1.0, np.exp(self.bias)])
        emit = np.stack([np.ones(k), np.exp(np.clip(e, -30, 30))], axis=1)
        alpha = np.empty((k, 2))
        for i in range(k):
            if i:
                a = (alpha[i - 1] @ self._gap(int(before[i]))) * emit[i]
            elif before[0]:
                a = (back @ self._gap(int(before[0]) - 1)) * emit[0]
            else:
                a = emit[0]
            alpha[i] = a / a.sum()
        rest = n - 1 - int(own[-1])
        beta = np.ones(2) if not rest else self._gap(rest - 1) @ back
        p = np.empty(k)
        for i in range(k - 1, -1, -1):
            g = alpha[i] * beta
            p[i] = g[1] / g.sum()
            if i:
                beta = self._gap(int(before[i])) @ (emit[i] * beta)
                beta /= beta.sum()
        return own, p

    @staticmethod
    def _summary(p: np.ndarray, n: int) -> list[float]:
        return [1.0, float(np.log1p(p.sum())), float(p.max()) if len(p) else 0.0, float(p.sum() / max(n, 1)) * 10.0]

    def score(self, p: np.ndarray, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.coef, self._summary(p, n)), -30, 30))))

    def tag(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """Of each text its score and the offending byte spans with their marginals."""
        starts, ends, ptr, whole, short = features(buf, offs)
        at, feat = [], []
        for h in (whole, *short):
            i, rank = self.known.index(h) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            at.append(i)
            feat.append(rank)
        at, feat = np.concatenate(at), np.concatenate(feat)
        order = np.argsort(at, kind="stable")
        at, feat = at[order], feat[order]
        cut = np.searchsorted(at, ptr)
        clean: dict[int, float] = {}
        for d in range(len(offs) - 1):
            a, n = int(ptr[d]), int(ptr[d + 1] - ptr[d])
            if cut[d] == cut[d + 1]:
                if n not in clean:
                    clean[n] = self.score(np.zeros(0), n)
                yield clean[n], []
                continue
            own, p = self.marginals(*self._emissions(at[cut[d] : cut[d + 1]] - a, feat[cut[d] : cut[d + 1]]), n)
            yield self.score(p, n), [(int(starts[a + w] - offs[d]), int(ends[a + w] - offs[d]), float(x)) for w, x in zip(own, p, strict=True) if x >= 0.5]


def sample_labelled(docs: DataFrame, labels: DataFrame, train, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(id, y, text) of at most ``sample`` labelled texts of each class among the rows that ``train`` admits.

    The rows with the smallest hash of their id; a document with several labels has the
    highest, and a document given in several rows counts once.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y")).where(train(F.col("id")))
    order = F.xxhash64(F.lit(seed), "id")
    ids = own.where("y = 1").orderBy(order, "id").limit(sample).union(own.where("y = 0").orderBy(order, "id").limit(sample))
    rows = docs.select(F.col(doc_id).alias("d_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(ids), F.col("d_id") == F.col("id"))  # 2 * sample ids at most
    return rows.groupBy("id", "y").agg(F.min("t").alias("text"))


def _associate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Association()
    for b in batches:
        y = b.column("y").to_numpy()
        for d, rows in feature_rows(as_strings(b.column("text"))):
            found.add(bool(y[d]), rows)
    hashes, marks = found.found()
    yield pa.RecordBatch.from_arrays([pa.array([hashes.tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary())], names=["hashes", "marks"])


def _reduced(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field()
        field.known = HashSet(hashes)
        for b in batches:
            got = [(len(rows), *(x.astype(np.int32).tobytes() for x in field.look(rows))) for _, rows in feature_rows(as_strings(b.column("text")))]
            words, places, feats = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(words, pa.int64()), pa.array(places, pa.binary()), pa.array(feats, pa.binary())], names=["id", "y", "words", "places", "feats"])

    return run


def _learnt(hashes: np.ndarray, marks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, texts = [], []
        for b in batches:
            y += b.column("y").to_pylist()
            texts += [(n, np.frombuffer(w, np.int32).astype(np.int64), np.frombuffer(f, np.int32).astype(np.int64)) for n, w, f in zip(*(b.column(c).to_pylist() for c in ("words", "places", "feats")), strict=True)]
        field = Field()
        field.known = HashSet(hashes)
        field.learn(texts, np.array(y, float), marks)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (field.weights, np.array([field.bias, *field.step.ravel(), *field.coef]))], names=["weights", "rest"])

    return run


def score_toxicity(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic_spans (byte offsets and marginals >= 0.5).

    Only the text is read: null and empty texts get the score of a text without findings.
    Columns of these names in ``docs`` are replaced.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("toxicity", "toxic_spans")
    kind = base.select("*", F.lit(0.0).alias("toxicity"), F.array().cast("array<struct<start:int,end:int,p:double>>").alias("toxic_spans")).schema
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for _, _, buf, offs in slices(as_strings(b.column(text))) for x in field.tag(buf, offs)]
            out = [pa.array([s for s, _ in found], pa.float64()), pa.array([[{"start": a, "end": e, "p": p} for a, e, p in x] for _, x in found], spans)]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "toxicity", "toxic_spans"])

    return base.mapInArrow(tidy(run), kind)


def fold(doc_id, n: int = 3):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, held: int | None = 1, sample: int = SAMPLE) -> Field:
    """The field fitted on labelled rows outside fold ``held`` (None: on all).

    The sample is written to the shared folder. Tasks that see all of it hold its hashes of
    toxic texts, or its weighted words; the driver gets the weights.
    """
    small_batches(docs.sparkSession)
    texts = stored(sample_labelled(docs, labels, lambda c: F.lit(True) if held is None else fold(c) != held, sample=sample), "labelled-sample")
    hashes, marks = texts.repartition(1).sortWithinPartitions(F.desc("y"), "id").mapInArrow(tidy(_associate), "hashes binary, marks binary").first() or (b"", b"")
    field, hashes, marks = Field(), np.frombuffer(hashes, _U), np.frombuffer(marks, bool)
    few = texts.mapInArrow(tidy(_reduced(hashes)), texts.select("id", "y", F.lit(0).cast("long").alias("words"), F.lit(b"").alias("places"), F.lit(b"").alias("feats")).schema)
    got = few.repartition(1).sortWithinPartitions("id").mapInArrow(tidy(_learnt(hashes, marks)), "weights binary, rest binary").first()
    if got is None:  # no labelled text
        return field.learn([], np.zeros(0), marks)
    field.known = HashSet(hashes)
    field.weights, rest = (np.frombuffer(x) for x in got)
    field.bias, field.step, field.coef = float(rest[0]), rest[1:5].reshape(2, 2), rest[5:]
    return field


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by the field learnt outside the held-out fold."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
