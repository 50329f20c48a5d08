"""Repetition coverage, source divergence and vector codes against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# --- repetition -----------------------------------------------------------------------------


def plain_repetition(text, lengths=(5, 6, 8, 10)):
    text = text or ""
    words = WORD.findall(text)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        inside = WORD.findall(line)
        if inside:
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, inside))
            seen.add(line)
    grams, chars = [], []
    for n in lengths:
        places = {}
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
        hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(n)}
        grams.append(len(hit))
        chars.append(sum(len(words[i]) for i in hit))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, dup_chars, grams, chars


TEXTS = [
    None, "", "  \n\t\n ", "one", "é é é é é é é", "a b c d e f g h i j", "\n".join(["the same line here"] * 6), "a b\na b \na b", "x\n\nx\n\nx", "x\r\nx\r\n", "#*$%&|<> plain < text",
    " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i % 9}" for i in range(60)), " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(7)), "y" * 50_000, "a b c d e a b c d e",
    "A b c d e a b c d e", "a b c d e", "日本 語 の 文 章 日本 語 の 文 章", "l\x0bl\x0cl l l l l l l l l", "end\n", "end\nend", " lead\n lead\nlead",
]


def test_repetition(spark):
    from rankweave.llm.repetition import quality_digest, repetition

    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(rng.choice([f"v{i}" for i in range(k)], 200)) for k in (2, 3, 8, 40, 400)] + [TEXTS[6]]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "a b c", None, None), (3, "one", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(2)
    key = lambda i: (i is None, i)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.dup_line_chars, r.gram_words, r.gram_chars) for r in repetition(docs).collect()), key=lambda r: key(r[0]))
    want = sorted(((i, *plain_repetition(t)) for i, t, *_ in rows), key=lambda r: key(r[0]))
    assert got == want
    for r in quality_digest(docs).collect():
        words, size, _, _, lines, grams, chars = plain_repetition(next(t for i, t, *_ in rows if i == r.doc_id))
        assert r.base_failed == (words < 10 or 100 * grams[0] > 20 * words)
        over = lines > 0.3 * size or any(c > s * size for c, s in zip(chars, (0.3, 0.3, 0.28, 0.25), strict=True))
        assert r.kept == (not r.base_failed and not over)
    assert quality_digest(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        repetition(docs, lengths=(5, 5))


def test_repetition_does_not_join_texts():
    """Windows and lines that follow one another in a slice belong to their own texts."""
    from rankweave.llm.repetition import measures

    texts = ["a b c d e f", "a b c d e f", "q", "", "q\nq", "b c d e f a b c d e f"]
    data = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, data)])
    got = measures(np.frombuffer(b"".join(data), np.uint8), offs)
    for i, t in enumerate(texts):
        words, size, symbols, dup, dup_chars, grams, chars = plain_repetition(t)
        assert (got["n_words"][i], got["word_chars"][i], got["n_dup_lines"][i], got["dup_line_chars"][i]) == (words, size, dup, dup_chars)
        assert got["words"][i].tolist() == grams and got["chars"][i].tolist() == chars


# --- divergence -----------------------------------------------------------------------------


def plain_audit(rows, least, top):
    groups, in_docs = {}, Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(words)
        in_docs.update((lang, w) for w in set(words))
    out = set()
    for lang, by in groups.items():
        kept = sorted(w for (x, w), n in in_docs.items() if x == lang and n >= least)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        whole = share(sum(by.values(), Counter()))
        p = {s: share(c) for s, c in by.items()}
        diff = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(-sum(diff(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in by if o != s]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            terms = [(-diff(p[s][w], whole[w]), w.encode(), w) for w in kept if by[s][w] and p[s][w] > whole[w]]
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(sorted(terms)[:top])}
    return out


@pytest.mark.parametrize(("heavy", "tile", "block"), [(0.25, 512, 128), (0.0, 3, 2), (2.0, 512, 2), (0.5, 4, 3)])
def test_divergence(spark, monkeypatch, heavy, tile, block):
    from rankweave.llm import divergence

    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "é", "ß", "Y", "y", "日本")]
    rows = []
    for k in range(160):
        some = rng.choice(words, int(rng.integers(0, 30)), p=rng.dirichlet(np.full(len(words), 0.4)))
        rows.append((["en", "de", None][k % 3], [f"s{int(rng.integers(0, 6))}", "ünd", None, ""][k % 4 if k % 9 == 0 else 0], "-1 ".join(some)))
    rows += [("fr", "alone", "mot mot"), ("it", "a", "uno"), ("it", "b", None), ("en", "without", ""), ("en", "without", "12 34"), ("de", "s0", None)] + [("en", "s1", "same words Same")] * 12
    docs = spark.createDataFrame([(*r, i, 1.5) for i, r in enumerate(rows)], "lang string, source string, text string, n long, value double").repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, least=5, top=4, heavy=heavy, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 5, 4)
    assert divergence.divergence_digest(docs.where("false")).count() == 0


def test_shares_of_large_counts():
    from rankweave.llm.divergence import shares

    for n, total in ((10**13, 3 * 10**13), (0, 10**15), (7, 9), (10**13 - 2, 10**13)):
        assert int(shares(np.array([n]), np.array([total]))[0]) == 1 + 10**9 * (n + 2) // total


# --- vector codes ---------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda v, p: min((far(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [{} for _ in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                held[p].setdefault(code(v, p)[1], []).append(cut(v, p))
        for p in range(parts):
            for j, some in held[p].items():
                books[p][j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out, by = {}, Counter()
    for i, label, v in kept:
        got = [code(v, p) for p in range(parts)]
        out[i] = (label, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got))
        by[label] += out[i][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {i: (c, e, by[label], digest) for i, (label, c, e) in out.items()}


def test_codes(spark):
    from rankweave.llm.vector_codes import compress, compression_digest

    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[40:60] = data[3]  # copies, and so entries that tie
    data[100:120, :4] = 0.25
    rows = [(i, [float(x) for x in v], None if i % 11 == 0 else i % 3) for i, v in enumerate(data)]
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] + [0.0] * 7, 2), (904, [0.0] * 8, 5), (905, [-0.0001] * 8, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in compression_digest(table).collect()}
    assert got == plain_codes(rows)
    few = table.where("vec_id in (5, 9, 900, 904)")
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in compression_digest(few).collect()} == plain_codes([r for r in rows if r[0] in (5, 9, 900, 904)])
    assert compression_digest(table.where("false")).count() == 0
    odd = spark.createDataFrame([(1, [], 1), (2, [1.0, 2.0, 3.0], 1), (3, [1.0] * 8, 1), (4, [1.0] * 4, 1), (5, [1e30] * 8, 1), (None, [1.0] * 8, 1), (3, [1.0] * 8, 1)], "vec_id long, embedding array<double>, label int")
    codes, books = compress(odd)
    assert sorted((str(r.vec_id), r.code, r.error) for r in codes.collect()) == [("3", "00000000", 0), ("3", "00000000", 0), ("None", "00000000", 0)] and len(books[0]) == 3


@pytest.mark.parametrize(("size", "width"), [(300, 16), (90_000_000, 4), (3, 16), (20_000_000, 64)])
def test_screening_is_exact(size, width):
    """Near ties, copies and large components: the codes are those of integer arithmetic."""
    from rankweave.llm.vector_codes import nearest

    rng = np.random.default_rng(size)
    book = rng.integers(-size, size, (256, width))
    book[17] = book[200]
    book[31] = book[30]
    book[31, 0] += 1
    x = np.concatenate([rng.integers(-size, size, (200, width)), book[:50], (book[:100] + book[100:200]) // 2])
    code, far, n = nearest(x, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(book)) for v in x]
    assert [(int(d), int(j)) for d, j in zip(far, code, strict=True)] == want
    assert len(x) <= n < x.shape[0] * 256
