"""The training-data operators against brute force on small tables, edge cases included."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, a shared passage, odd texts, and columns with clashing names."""
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, int(rng.integers(1, 160)))) for i in range(60)]
    passage = prose(rng, 60)
    rows += [(100 + i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}") for i in range(8)]
    rows += [(200 + i, rows[3][1]) for i in range(12)]
    long = prose(rng, 300).split()
    for i in range(10):
        edited = list(long)
        edited[17 * i + 5] = f"edit{i}"
        rows.append((300 + i, " ".join(edited)))
    rows += [(400, None), (401, ""), (402, "   "), (403, "é" * 80), (404, "aé" + "é" * 80), (405, "Short"), (406, "x" * 30_000), (407, "short")]
    out = [(i, t, "en", None if i % 7 == 0 else f"src{i % 5}", len(t or ""), "clash", True) for i, t in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, size string, contaminated boolean").repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    from rankweave.llm.components import connected_components

    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    want = components({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark, tmp_path):
    from rankweave.llm.warc import read_foreign_warc, resolve_revisits, warc_round_trip, write_warc

    odd = "a\r\n\r\nWARC/1.1\r\nx"
    rows = [(1, "u", odd), (2, "u\r\nX: y", odd), (3, None, None), (4, "e", ""), (None, "z", "q"), (None, "z", "q"), (5, "z", "q"), (6, "t", "tail\r\n"), (7, "t", "\r\n\r\n"), (8, "t", "é\r"), (9, "t", "y" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    want = []
    for b, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if i == top else ("revisit", top))) for i in ids]
    got = warc_round_trip(pages).collect()
    assert all(r.intact for r in got)
    key = lambda x: (str(x[0]), x[2])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    write_warc(resolve_revisits(pages), str(tmp_path / "w"))
    ids = [r.record_id for r in read_foreign_warc(spark, str(tmp_path / "w")).collect()]
    assert len(ids) == len(rows) == len(set(ids))
    record = lambda i, block, size=None: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n{block}\r\n\r\n"
    (tmp_path / "foreign.warc").write_bytes((record("a", "x\nWARC/1.1 is no record") + "WARC/1.1\r\nContent-Length: what\r\n\r\nlost\r\n\r\n" + record("b", "") + record("c", "short", 99) + record("d", "last")[:-4]).encode())
    assert [(r.record_id, bytes(r.block)) for r in read_foreign_warc(spark, str(tmp_path / "foreign.warc")).collect()] == [("a", b"x\nWARC/1.1 is no record"), ("b", b""), ("d", b"last")]
    clash = pages.withColumns({"revisit": F.lit("x"), "payload_digest": F.lit(1)})
    for n in (0, 50_000):
        far = resolve_revisits(clash, broadcast_revisits=n)
        assert sorted(map(str, far.collect())) == sorted(map(str, resolve_revisits(pages).collect()))
    small = by_id(resolve_revisits(pages, min_bytes=1), "page_id")
    assert not small[3].revisit and not small[4].revisit and small[1].revisit
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_embeddings(spark):
    from rankweave.llm.embed_dedup import near_duplicates

    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base[:10] + 0.05 * rng.normal(size=(10, 16)), np.repeat(base[3:4], 30, 0) + 0.02 * rng.normal(size=(30, 16))])
    vec = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(np.concatenate([base, near, base[:4]]))]
    vec += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None, *[1.0] * 15], 1), (1004, vec[0][1], None), (1005, [], 1), (1006, vec[2][1], 0), (1007, [2 * x for x in vec[2][1]], 0)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, float), lab) for i, v, lab in vec if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98]
    want, n = components([v[0] for v in vec], links), Counter(x for e in links for x in e)
    for block in (1024, 8):
        got = by_id(near_duplicates(df, block=block), "vec_id")
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], c, c == i) for i, c in want.items()}
    assert near_duplicates(df.limit(0)).count() == 0


def shingles(t):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(spark, docs):
    from rankweave.llm.ngram_join import jaccard_join, one_of_each_group

    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    links = [(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and s and t and len(s & t) >= 0.8 * len(s | t)]
    want, n = components(sets, links), Counter(x for e in links for x in e)
    assert max(n.values()) > 10
    for sizes in ({}, {"small": 3, "block": 4}):
        got = by_id(jaccard_join(docs, **sizes))
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (n[i], c) for i, c in want.items()}
    kept = one_of_each_group(docs.union(docs.where("doc_id = 1")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want.values()}) and kept.columns == docs.columns
    assert jaccard_join(docs.limit(0)).count() == 0 and one_of_each_group(docs.limit(0)).count() == 0


def test_one_id_on_several_texts(spark):
    """Each row goes or stays by its own text; rows with a null id or no words stay."""
    from rankweave.llm.ngram_join import jaccard_join, one_of_each_group

    rng = np.random.default_rng(21)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(3, a, "s"), (5, a + " more", "t"), (5, b, "s"), (7, c, "s"), (7, c + " x", "t"), (7, c, "u"), (None, a, "s"), (None, a, "s"), (9, None, "s"), (9, None, "t"), (9, "", "s"), (10, " ", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in one_of_each_group(d).collect())
    assert got == Counter({(3, a): 1, (5, b): 1, (None, a): 2, (9, None): 1, (9, ""): 1, (10, " "): 1}) + Counter({max([(7, c), (7, c + " x")], key=lambda k: got[k]): 1})
    assert jaccard_join(d).where("doc_id is null").select("kept", "n_links").distinct().collect() == [(True, 0)]


def test_recall_of_chosen_paths(spark):
    """The share of all links at the threshold that trees of few runs find, and of many, against brute force."""
    from rankweave.llm.ngram_join import jaccard_join, least_equal, runs_for

    assert runs_for(0.8, 3, 0.99) < runs_for(0.8, 3, 0.9999) < runs_for(0.8, 5, 0.9999) and least_equal(0.8, 0.9) > least_equal(0.8, 0.9999)
    rng = np.random.default_rng(22)
    rows, sets = [], {}
    for i in range(300):  # pairs near the threshold: words changed at one place or two
        words = prose(rng, int(rng.integers(30, 120))).split()
        for j in range(2):
            if j:
                for k in rng.integers(0, len(words), int(rng.integers(1, 3))):
                    words[k] = "changed"
            rows.append((2 * i + j, " ".join(words)))
            sets[2 * i + j] = shingles(rows[-1][1])
    links = {(2 * i, 2 * i + 1) for i in range(300) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for recall in (0.5, 0.9, 0.9999):
        got = by_id(jaccard_join(d, recall=recall, small=8))
        found[recall] = sum(got[a].n_links == 1 and got[b].component_id == a for a, b in links) / len(links)
        assert sum(r.n_links for r in got.values()) <= 2 * len(links)
    assert len(links) > 60 and found[0.5] >= 0.5 and found[0.9] >= 0.9 and found[0.9999] == 1


def test_html():
    from rankweave.llm.html_extract import declared, parse

    t = lambda s: [b.text for b in declared(parse(s))]
    page = '<html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c --><div class="ad">AD</div><article><h1>T &amp; x</h1><p><b>one  two.<br><p>three &eacute; &#233;<p>four <i>it</i>alic</p><div class="notice">N</div><section class="comments"><article class="comment">hey</article></section><form><p>F</p></form></article><aside>s</aside><footer>&copy;</footer></body></html>'
    assert t(page) == ["T & x", "one two.", "three é é", "four italic"]
    assert t(None) == t("") == [] and t("plain < 5 & more <b>x</b>") == ["plain < 5 & more x"]
    assert t("<div id=content><p>a<p>b</div><div class='sidebar'>z</div>") == ["a", "b"]
    assert t("<p>a<span hidden>h</span>b</p>") == ["ab"] and t('<div class="with-sidebar"><p>q</p></div>') == ["q"]
    assert t("<p>x" + "<b>" * 3000 + "y" * 50_000)[0].startswith("xy")


def _site(n, host="a.com"):
    """Pages of one layout without any declared role, whose article alone differs in presentation."""
    rng = np.random.default_rng(12)
    pages = []
    for i in range(n):
        body = "".join(f"<p>{prose(rng, 8)}{'<b>x</b>' if rng.random() < 0.3 else ''}</p>" for _ in range(int(rng.integers(1, 9))))
        pages.append((i, f"http://{host}/{i}", f"<div class=x1><a>{prose(rng, 2)}</a><a>q</a></div><div class=x2>{prose(rng, 4)}</div><div class=x3><h1>title {i}</h1>{body}</div><div class=x4>{host} all rights</div>"))
    return pages


def test_style_tree(spark):
    from rankweave.llm.html_extract import extract, parse

    rows = [(i, f"http://a.com/{i}", f"<div class=x><p>Subscribe today</p></div><div class=y><p>story {i} {'z' * i}</p></div>") for i in range(12)]
    rows += [(100 + i, "http://b.com/", "<p>one page, many copies</p>") for i in range(20)] + [(200, None, "<p>t</p>"), (201, "http://a.com", None)]
    got = by_id(extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[3].text == "story 3 zzz" and got[3].n_chars == 11
    assert got[100].text == "one page, many copies" and got[200].text == "t" and got[201].text == "" and len(got) == len(rows)
    # the tree alone finds the article: no role is declared, and contents differ everywhere but in x4
    site = _site(30)
    df = spark.createDataFrame([*[(*r, "clash") for r in site], (500, "http://a.com/z", "<div class=y9><p>other layout</p></div>", "c"), (501, site[0][1], site[0][2], "again")], "page_id long, url string, html string, text string")
    want = {i: "\n".join(b.text for b in parse(h[h.index("<div class=x3>") : h.index("<div class=x4>")])) for i, _, h in site}
    for kw in ({"roles": False}, {}, {"broadcast_nodes": 0}):
        got = by_id(extract(df, **kw), "page_id")
        assert {i: got[i].text for i in want} == want and got[501].text == want[0] and got[500].text == "other layout"
    off = by_id(extract(df, min_pages=1000, roles=False), "page_id")
    assert all(off[i].text != t for i, t in want.items())
    assert extract(df.limit(0)).count() == 0 and extract(df).columns == ["page_id", "url", "text", "n_chars"]


def test_style_tree_entropies(spark):
    """Importance and verdicts against entropies summed in plain Python."""
    from rankweave.llm.html_extract import _chain, parse, style_tree

    site = _site(25) + _site(9, "b.org")
    got = {(r.host, r.node): r for r in style_tree(spark.createDataFrame([(u.split("/")[2], h) for _, u, h in site] * 2, "host string, html string")).collect()}
    for host, pages in (("a.com", [h for _, u, h in site if "a.com" in u]), ("b.org", [h for _, u, h in site if "b.org" in u])):
        style, content, chains = {}, {}, {}
        for h in pages:
            own_s, own_c, seen = {}, {}, set()
            for x in parse(h):
                own_c.setdefault(x.element.node, []).append(x.text)
                e = x.element
                while e.parent is not None:
                    if id(e) not in seen:
                        seen.add(id(e))
                        own_s.setdefault(e.node, []).append(tuple(e.children))
                    chains[e.node] = _chain(e)
                    e = e.parent
            for n, v in own_s.items():
                style.setdefault(n, Counter())[tuple(v)] += 1
            for n, v in own_c.items():
                content.setdefault(n, Counter())[tuple(v)] += 1
        entropy = lambda c: -sum(x / c.total() * math.log(x / c.total()) for x in c.values()) / math.log(c.total()) if c.total() > 1 else 1.0
        often = {n for n, c in style.items() if c.total() >= 8}
        leaves = {}
        for n in often:
            below = [m for m in often if n in chains[m] and m in content]
            leaves[n] = sum(entropy(content[m]) * content[m].total() for m in below) / sum(content[m].total() for m in below) if below else None
        own = {n: entropy(style[n]) * (leaves[n] or 0.0) for n in often}
        branch = {n: max(own[m] for m in often if n in chains[m]) for n in often}
        up = lambda n: (chains[n] + [0])[1]
        assert often == {n for h, n in got if h == host}
        for n in often:
            most = max(branch[m] for m in often if up(m) == up(n))
            verdict = (most >= 0.05 and branch[n] < 0.75 * most) + 2 * (branch[n] >= 0.05 and own[n] >= 0.3 * branch[n]) + 4 * (leaves[n] is not None and leaves[n] < 0.2)
            r = got[host, n]
            assert (r.importance, r.branch, r.verdict) == (pytest.approx(own[n]), pytest.approx(branch[n]), verdict)


def test_urls(spark):
    from rankweave.llm.url_filter import filter_urls

    rows = [(1, None), (2, "abc"), (3, "http://EXAMPLE.com/en/x"), (4, "http://www.example.com/en/y"), (5, "x://a.net/es/"), (6, "x://a.net"), (7, "http://example.com"), (8, "http://notexample.com/en/"), (9, "ftp://a.fr.net/fr/é?x://b"), (10, "h://Z.com#/en/")]
    got = by_id(filter_urls(spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id long, url string, host string")), "page_id")
    want = {1: ("", "", None), 2: ("", "", None), 3: ("example.com", "/en/x", "example.com/en/"), 4: ("www.example.com", "/en/y", "www.example.com/en/"), 5: ("a.net", "/es/", "net/es/"), 6: ("a.net", "", None), 7: ("example.com", "", None), 8: ("notexample.com", "/en/", "com/"), 9: ("a.fr.net", "/fr/é", "net/fr/"), 10: ("z.com", "", None)}
    assert {i: (r.host, r.path, r["rule"]) for i, r in got.items()} == want
    assert got[3].verdict == got[5].verdict == "block" and got[4].verdict == got[8].verdict == got[1].verdict == "allow"
    bad = [(i, f"http://s.org/bad/{i}") for i in range(40)] + [(100 + i, f"http://s.org/ok/{i}") for i in range(40)]
    rules = (("s.org", "/bad/1", "block"), ("s.org", "/ok/1", "allow"))
    got = by_id(filter_urls(spark.createDataFrame(bad, "page_id long, url string"), rules=rules), "page_id")
    assert got[25].rule is None and got[25].verdict == "block" and got[125].verdict == "allow"


def _plain_templates(rows, fan_out):
    """Templates of (host, path, judged, blocked) by recursion over dictionaries: {(host, shape): (template, purity, rejected)}."""
    kinds = ("{n}", "{date}", "{hex}", "{code}")

    def shape(x):
        for pattern, kind in ((r"[0-9]+", "{n}"), (r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{date}")):
            if re.fullmatch(pattern, x):
                return kind
        if re.fullmatch(r"[0-9]+\.[A-Za-z]+", x):
            return "{n}." + x.split(".")[-1]
        return "{hex}" if re.fullmatch(r"[0-9a-fA-F-]{16,}", x) else "{code}" if len(re.sub("[^0-9]", "", x)) >= 3 else x

    bound = lambda n, m: math.sqrt(math.log(40) / 2) * (n**-0.5 + m**-0.5)
    base = {}
    for host, path, j, b in rows:
        x = base.setdefault((host, tuple(shape(s) for s in re.split("/+", path) if s)), [0, set(), 0, 0])
        x[0], x[2], x[3] = x[0] + 1, x[2] + j, x[3] + b
        x[1].add(path)
    out = {}

    def walk(host, head, group):  # group: (shape, rest, n, paths, judged, blocked)
        low, high = min(g[1] for g in group), max(g[1] for g in group)
        same = next((i for i in range(min(len(low), len(high))) if low[i] != high[i]), min(len(low), len(high)))
        head += "".join("/" + x for x in low[:same])
        group = [(g[0], g[1][same:], *g[2:]) for g in group]
        for g in group:
            if not g[1]:
                out[host, "/".join(g[0])] = (head, g[2], g[4], g[5])
        group = [g for g in group if g[1]]
        literal = [g for g in group if g[1][0] not in kinds]
        kids = {g[1][0] for g in literal}
        if len(kids) > fan_out and (sum(g[3] for g in literal) < 4 * len(kids) or len(kids) > 10 * fan_out):
            group = [(g[0], ("*", *g[1][1:]), *g[2:]) if g[1][0] in kids else g for g in group]
        child = {}
        for g in group:
            c = child.setdefault(g[1][0], {"sig": Counter(), "j": 0, "b": 0})
            c["sig"]["/".join(x if x in kinds else "w" for x in g[1][1:])] += g[3]
            c["j"], c["b"] = c["j"] + g[4], c["b"] + g[5]
        named = {}
        tops = {}
        for k, c in child.items():
            best = max(c["sig"].values())
            tops.setdefault(frozenset(s for s, v in c["sig"].items() if v == best), []).append(k)
        assert all(len(t) == 1 for t in tops), "ties are left to the hash"
        for top, members in tops.items():
            pool = sum((child[k]["sig"] for k in members), Counter())
            j, b, n = sum(child[k]["j"] for k in members), sum(child[k]["b"] for k in members), pool.total()
            for k in members:
                c = child[k]
                m = c["sig"].total()
                gap = max(*(abs(v / m - pool[s] / n) for s, v in c["sig"].items()), 1 - sum(pool[s] / n for s in c["sig"]))
                q = (b + 1) / (j + 2)
                over = c["b"] - c["j"] * q
                off = 0 if abs(over) <= 1.64 * math.sqrt(c["j"] * q * (1 - q)) else (over > 0) - (over < 0)
                named.setdefault((top, off) if gap <= bound(m, n) else k, []).append(k)
        for members in named.values():
            name = f"({'|'.join(sorted(members))})" if len(members) > 1 else members[0]
            walk(host, f"{head}/{name}", [(g[0], g[1][1:], *g[2:]) for g in group if g[1][0] in members])

    for host in {h for h, _ in base}:
        walk(host, "", [(s, s, n, len(p), j, b) for (h, s), (n, p, j, b) in base.items() if h == host])
    own, over_all = {}, {}
    for (host, _), (t, _, j, b) in out.items():
        for table, key in ((own, (host, t)), (over_all, t)):
            x = table.setdefault(key, [0, 0])
            x[0], x[1] = x[0] + j, x[1] + b
    purity = {(h, t): (b + 4 * (over_all[t][1] + 2) / (over_all[t][0] + 4)) / (j + 4) for (h, t), (j, b) in own.items()}
    return {(h, s): (t, pytest.approx(purity[h, t]), own[h, t][0] > 0 and purity[h, t] > 0.5) for (h, s), (t, *_) in out.items()}


def test_path_templates(spark):
    """Wildcards, merges at every level and purities against plain recursion; labels reach unlabelled kin."""
    from rankweave.llm.url_filter import filter_urls, learn_templates

    rng = np.random.default_rng(14)
    rows = []
    for i in range(400):
        lang = str(rng.choice(["de", "en", "es", "fr"]))
        rows.append(("a.net", f"/{lang}/{i}", int(lang in "es fr"), int(lang in "es fr")))
        rows.append(("b.net", f"/{lang}/{i}/x/y/z/{'q' if i % 3 else 'r'}/{i % 7}", int(lang in "es fr"), int(lang == "es")))
        rows.append(("c.org", f"/user/name{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i % 6]}/photos", 1, i % 2))
        rows.append(("c.org", f"/big/{'abcdefgh'[i % 8]}/{i}", 0, 0))
    rows += [("d.org", "/" + "s/" * 300 + e, 0, 0) for e in ("a", "b", "b")] + [("", "", 0, 0), ("e.org", "//", 0, 0), ("e.org", "/one//two/", 1, 1), ("f.org", "/2024-01-02/12.html", 1, 0), ("f.org", "/{n}/*", 0, 0)]
    df = spark.createDataFrame([(h, p, j, b) for h, p, j, b in rows], "host string, path string, judged long, blocked long")
    got = {(r.host, r["shape"]): (r.template, r.purity, r.rejected) for r in learn_templates(df, fan_out=20).collect()}
    want = _plain_templates(rows, 20)
    assert got == want
    assert got["a.net", "en/{n}"] == ("/(de|en|es|fr)/{n}", want["a.net", "en/{n}"][1], True)  # en has no label of its own
    assert any("*" in t for (h, _), (t, *_) in got.items() if h == "c.org") and got["b.net", "es/{n}/x/y/z/q/{n}"][2] and not got["b.net", "fr/{n}/x/y/z/q/{n}"][2]
    assert learn_templates(df.limit(0)).count() == 0 and filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, *_) in enumerate(rows) if h] + [(0, "http://a.net/" + "x" * 200_000)], "page_id long, url string")
    out = filter_urls(pages.union(pages.limit(3)))
    assert out.count() == pages.count() + 3 and out.where("verdict is null").count() == 0


def test_decontamination(spark, docs):
    from rankweave.llm.decontam import decontaminate, decontamination_digest, remove_spans, words_of

    texts = {r.doc_id: r.text for r in docs.collect()}
    w = texts[100].split()
    items = [(1, " ".join(w[30:60])), (2, "SHORT"), (3, None), (4, ""), (5, " ".join(w[40:52])), (5, " ".join(w[40:52])), (6, " ".join(w[35:48]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        x = words_of(t)
        for k in range(max(1, len(x) - 12)) if x else ():
            windows.setdefault(tuple(x[k : k + 13]), set()).add(str(i))
    got = by_id(decontamination_digest(docs, bench))
    for i, t in texts.items():
        x, hit, found = words_of(t), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(x) - size + 1):
                if (k := tuple(x[a : a + size])) in windows:
                    found |= windows[k]
                    hit |= set(range(a, a + size))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(x), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r.contaminated == (bool(hit) and 20 * len(hit) >= len(x))
    shards = by_id(decontaminate(docs, bench, shard_bytes=100))
    assert {i: (r.n_hit, len(r.hit_items)) for i, r in shards.items()} == {i: (r.n_hit, r.n_items) for i, r in got.items()}
    cut = by_id(remove_spans(decontaminate(docs, bench), max_share=0.9))
    assert w[45] not in cut[101].text.split()[28:] and cut[0].text == texts[0]
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0
    twice = decontaminate(docs.union(docs), bench).groupBy("doc_id", "n_hit", "hit_items").count().collect()
    assert {r["count"] for r in twice} == {2} and len(twice) == len(texts)


def test_automaton_of_repetitive_items():
    """Window occurrences against plain comparison, for items over two words with long repeats."""
    from rankweave.llm.decontam import SuffixAutomaton

    rng = np.random.default_rng(17)
    for window in (1, 3, 5):
        items = [(k, [bytes([97 + int(x)]) for x in rng.integers(0, 2, int(rng.integers(0, 14)))]) for k in range(12)]
        a = SuffixAutomaton(items, window)
        for _ in range(30):
            text = [bytes([97 + int(x)]) for x in rng.integers(0, 3, 25)]
            want = {(i, i + n, k) for k, w in items if w for n in [min(window, len(w))] for j in range(len(w) - n + 1) for i in range(len(text) - n + 1) if text[i : i + n] == w[j : j + n]}
            assert set(a.matches(text)) == want


def test_repeats(spark, docs):
    from rankweave.llm.sa_dedup import remove_repeats

    small = {"hot": 3, "block": 3000, "segment_shard": 2000, "anchor_shard": 4000}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    seen, want = {}, {}
    for r in rows:
        b = (r.text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen.get(b[i : i + 50], r.doc_id) < r.doc_id:
                gone[i : i + 50] = True
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], r.doc_id)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) if len(b) else 0
        want[r.doc_id] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    for sizes in ({}, small):
        got = by_id(remove_repeats(docs, **sizes))
        assert {i: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for i, r in got.items()} == want
    assert got[0].kept_text == rows[0].text and got[201].kept_text == ""
    assert remove_repeats(docs.limit(0)).count() == 0
    # rows of one id never remove from each other, rows without an id neither remove nor lose
    odd = spark.createDataFrame([(1, rows[3].text), (1, rows[3].text), (None, rows[3].text), (None, rows[3].text), (2, None), (2, rows[3].text)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_removed) for r in remove_repeats(odd).collect()) == Counter({(1, 0): 2, (None, 0): 2, (2, 0): 1, (2, len(rows[3].text.encode())): 1})


def test_suffix_array():
    from rankweave.llm.sa_dedup import common_prefixes, suffix_array

    rng = np.random.default_rng(3)
    for text in (rng.integers(97, 99, 400).astype(np.uint8), np.full(60, 97, np.uint8), np.zeros(0, np.uint8)):
        raw = text.tobytes()
        sa, _ = suffix_array(text)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        for cap, lane in ((1000, 3), (1000, 256), (20, 7)):
            lcp = common_prefixes(text, sa, cap, lane)
            for k in range(1, len(sa)):
                a, b = raw[sa[k - 1] :], raw[sa[k] :]
                assert lcp[k] == min(cap, next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))


@pytest.mark.parametrize("block", [150, 400, 1 << 20])
def test_shards_of_several_suffix_arrays(block):
    """The smallest id of every string, however many arrays its anchor's segments are dealt to."""
    from rankweave.llm.sa_dedup import shard_least

    rng = np.random.default_rng(30)
    anchor = np.sort(rng.integers(0, 4, 40))
    core = [rng.integers(97, 123, 30).astype(np.uint8).tobytes() for _ in range(4)]
    segments = [bytes(rng.choice([97, 98], int(rng.integers(0, 4))).astype(np.uint8)) + core[a] + bytes(rng.choice([97, 98], int(rng.integers(0, 4))).astype(np.uint8)) for a in anchor]
    least = rng.permutation(1000)[:40]
    low = {}
    for s, i, a in zip(segments, least, anchor, strict=True):
        for k in range(len(s) - 29):
            low[a, s[k : k + 30]] = min(low.get((a, s[k : k + 30]), 10**9), i)
    offs = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    got = shard_least(np.frombuffer(b"".join(segments), np.uint8), offs, least, anchor, 30, block)
    assert got.tolist() == [low[a, s[k : k + 30]] for s, a in zip(segments, anchor, strict=True) for k in range(len(s) - 29)]
    assert len(shard_least(np.zeros(0, np.uint8), np.zeros(1, np.int64), least[:0], anchor[:0], 30)) == 0


def _plain_chain(e, step):
    """Marginals of state 1 and expected steps of one chain, word by word."""
    t, emit = np.exp(step), np.stack([np.ones(len(e)), np.exp(e)], 1)
    alpha, beta = [emit[0]], [np.ones(2)]
    for x in emit[1:]:
        alpha.append(alpha[-1] @ t * x)
    for x in emit[:0:-1]:
        beta.insert(0, t @ (x * beta[0]))
    z = alpha[-1].sum()
    steps = sum((np.outer(alpha[i - 1], emit[i] * beta[i]) * t / z for i in range(1, len(e))), np.zeros((2, 2)))
    return np.array([a[1] * b[1] / z for a, b in zip(alpha, beta, strict=True)]), steps


def test_chains_of_weighted_words():
    """The recursion over weighted words alone against one over every word, in learning and in use."""
    from rankweave.llm.toxicity import Chains, Field

    rng = np.random.default_rng(9)
    step, bias, weight = np.array([[0.3, -1.0], [-0.5, 0.8]]), -1.2, rng.normal(size=6)
    marks = np.array([True, False, True, False, False, True])
    texts, toxic = [], np.array([1, 0, 1, 1, 0, 1, 1], float)
    for n in (14, 9, 1, 40, 0, 25, 3):
        places = np.sort(rng.choice(n, min(n, [5, 0, 1, 12, 0, 3, 3][len(texts)]), replace=False)) if n else np.zeros(0, np.int64)
        places = np.concatenate([places, places[:1]])  # a word may have two features
        texts.append((n, np.sort(places), rng.integers(0, 6, len(places))))
    chains = Chains(texts, toxic, marks)
    e = np.bincount(chains.cell, weights=weight[chains.feat], minlength=len(chains.y)) + bias
    p, background, steps = chains.expected(e, bias, step)
    own, rest, all_steps, seen = [], 0.0, np.zeros((2, 2)), np.zeros((2, 2))
    f = Field()
    f.weights, f.bias, f.step = weight, bias, step
    for (n, w, x), bad in zip(texts, toxic, strict=True):
        if not n:
            continue
        full = np.full(n, bias)
        np.add.at(full, w, weight[x])
        q, s = _plain_chain(full, step)
        y = np.zeros(n, int)
        y[w[marks[x]]] = int(bad)
        np.add.at(seen, (y[:-1], y[1:]), 1)
        at = np.unique(w)
        own += q[at].tolist()
        rest += np.delete(q, at).sum()
        all_steps += s
        assert np.allclose(f.marginals(*f._emissions(w, x), n)[1], q[at])
    assert np.allclose(sorted(p), sorted(own)) and background == pytest.approx(rest) and np.allclose(steps, all_steps) and np.allclose(chains.seen, seen)


def test_toxicity_fit_is_the_same_dealt_out(spark):
    from rankweave.llm.toxicity import Field, fit_toxicity

    rng = np.random.default_rng(11)
    rows = [(i, prose(rng, 50) + (" vilew nastyx" if i % 3 == 0 else "")) for i in range(90)] + [(200, None), (201, "")]
    labels = [(i, int(i < 200 and i % 3 == 0)) for i, _ in rows]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = fit_toxicity(d.union(d.limit(5)), lab, held=None)
    want = Field().fit([t or "" for _, t in rows], np.array([y for _, y in labels]))
    assert np.allclose(got.weights, want.weights) and np.allclose(got.coef, want.coef, atol=1e-4) and got.bias == pytest.approx(want.bias)
    for lab in (lab.limit(0), lab.where("toxic = 0"), lab.where("toxic = 1")):
        assert 0 <= fit_toxicity(d, lab, held=None).score(np.zeros(0), 3) <= 1


def _plain_mix(rows, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0, miss=0.03, seed=0):
    """(id, size, source, target, copies) of (id, text, source), by plain systematic sampling."""
    size = [len(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {n: sum(z for z, (*_, s) in zip(size, rows, strict=True) if s == n) for n in names}
    w, left, free, aim = {n: weights[i % len(weights)] for i, n in enumerate(names)}, share * sum(size), set(names), {}
    while free:
        unit = (left - sum(aim.values())) / sum(w[n] for n in free)
        over = {n for n in free if w[n] * unit > cap * total[n]}
        aim |= {n: cap * total[n] for n in over} or {n: w[n] * unit for n in free}
        free -= over or free
    out = []
    for n in names:
        own = sorted(((z, i is not None, i or 0) for z, (i, _, s) in zip(size, rows, strict=True) if s == n))
        big = [x for x in own if x[0] > max(miss * aim[n], miss / 8 * total[n])][::-1]
        rest = [x for x in own if x[0] <= max(miss * aim[n], miss / 8 * total[n])]
        due, taken = 0.0, 0
        for x in big:
            rate = aim[n] / total[n]
            due += rate * x[0]
            k = min(max(math.floor((due - taken) / x[0] + 0.5), math.floor(rate)), math.ceil(rate))
            taken += k * x[0]
            out.append((x[2] if x[1] else None, x[0], total[n], aim[n], k))
        some = sum(x[0] for x in rest)
        rate = min(max((aim[n] - taken) / some, 0), cap) if some else 0.0
        key = f"{seed}:{n or ''}:{'null' if n is None else ''}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / 16**12
        out += [(x[2] if x[1] else None, x[0], total[n], aim[n], math.floor(k * rate + u) - math.floor((k - 1) * rate + u)) for k, x in enumerate(rest, 1)]
    return out


def test_mixing(spark, docs):
    """Against plain systematic sampling with the same offsets; sources of one document, of long ones, of none with words."""
    from rankweave.llm import mixing

    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, int(rng.integers(1, 80))), [None, "b", "a", "ä", "\U0001f600", "\ufb01"][i % 6]) for i in range(3000)] + [(5000, None, "a"), (5001, "", None), (5002, prose(rng, 3000), "a"), (5003, prose(rng, 9000), "long"), (5004, prose(rng, 2000), "long"), (5005, None, "none"), (5006, "x y", "one"), (None, "x y", "b")]
    rows += rows[:40]
    d = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(5)
    key = lambda r: (str(r[0]), *r[1:])
    want = sorted(_plain_mix(rows), key=key)
    for n in (100_000, 2):
        mixing.BROADCAST_ROWS = n
        try:
            got = sorted((tuple(r) for r in mixing.mix(d).collect()), key=key)
        finally:
            mixing.BROADCAST_ROWS = 100_000
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    for n in {s for *_, s in rows}:  # the stated bound, or what a source of one long document allows
        own = [r for r in want if r[2] == sum(len((t or "").split()) for _, t, s in rows if s == n)]
        assert abs(sum(r[4] * r[1] for r in own) - own[0][3]) <= 0.03 * own[0][3] or n in ("long", "one")
    assert all(r[4] <= 2 for r in want)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mix(docs).count() == docs.count()


def test_language_model(spark, docs):
    from rankweave.llm.lm_hmm import Model, score, scoring_digest

    got = by_id(scoring_digest(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    tok = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + ["end"]
    c = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) and r.score < 0
    few = by_id(score(docs, top=20, states=2, rounds=2))
    assert all(math.isfinite(r.score) for r in few.values()) and score(docs.limit(0)).count() == 0
    none = by_id(score(docs, held_out=F.lit(True)))
    assert none[0].train_tokens == 0 and none[0].n_known == 0
    # the scaled recursion against sums over all paths, and expected counts that add up
    m = Model(np.arange(4, 24, 4, dtype=np.uint64), np.arange(5, 0, -1), 3, np.array([20, 1, 1, 1]), np.array([6, 1, 1, 1]), 2)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, m.end + 1, 6).astype(np.uint16)
    want = 0.0
    for path in np.ndindex(*([2] * 6)):
        p = m.start[path[0]] * m.emit[path[0], ids[0]]
        for k in range(1, 6):
            p *= m.trans[path[k - 1], path[k]] * m.emit[path[k], ids[k]]
        want += p
    assert m.forward(ids, np.array([0, 6]))[0] == pytest.approx(math.log(want))
    long = rng.integers(0, m.end + 1, 500).astype(np.uint16)
    emit, _, start = m.expect(long, np.array([0, 0, 130, 500]))
    assert emit.sum() == pytest.approx(500) and start.sum() == pytest.approx(2)


def test_registered(spark):
    from rankweave.llm import queries

    assert len([q for q in queries.queries() if re.match(r"op\d+_", q)]) == 13 and "pipeline" in queries.queries()


@pytest.mark.parametrize("held", [1, 40, 400_000])
def test_expected_counts_of_long_texts(monkeypatch, held):
    """Against the plain recursions over each whole text, however few tokens are held at once."""
    from rankweave.llm import lm_hmm

    monkeypatch.setattr(lm_hmm, "HELD", held, raising=False)
    m = lm_hmm.Model(np.arange(4, 24, 4, dtype=np.uint64), np.arange(5, 0, -1), 3, np.array([20, 1, 1, 1]), np.array([6, 1, 1, 1]), 3)
    rng = np.random.default_rng(3)
    m.trans, m.start = (x / x.sum(-1, keepdims=True) for x in (rng.random((3, 3)), rng.random(3)))
    m.emit = rng.random(m.emit.shape)
    m.emit /= m.emit.sum(1, keepdims=True)
    ptr = np.array([0, 7, 7, 207, 337, 338])
    ids = rng.integers(0, m.end + 1, 338).astype(np.uint16)
    emit, trans, start = np.zeros_like(m.emit), np.zeros((3, 3)), np.zeros(3)
    for x in (ids[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True) if b > a):
        alpha, beta = [m.start * m.emit[:, x[0]]], [np.ones(3)]
        for i in x[1:]:
            alpha.append(alpha[-1] @ m.trans * m.emit[:, i])
        for i in x[:0:-1]:
            beta.insert(0, m.trans @ (m.emit[:, i] * beta[0]))
        total = alpha[-1].sum()
        start += alpha[0] * beta[0] / total
        for t, i in enumerate(x):
            emit[:, i] += alpha[t] * beta[t] / total
            if t:
                trans += np.outer(alpha[t - 1], m.emit[:, i] * beta[t]) * m.trans / total
    for got, want in zip(m.expect(ids, ptr), (emit, trans, start), strict=True):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert trans.sum() == pytest.approx(sum(max(0, k - 1) for k in np.diff(ptr)))
    for got, want in zip(m.expect(ids, ptr, np.float32), (emit, trans, start), strict=True):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_more_words_than_two_bytes_number(spark):
    """Words numbered above 65,535 keep emissions of their own."""
    from rankweave.llm import lm_hmm

    assert lm_hmm.own_words(0) == lm_hmm.own_words(1 << 29) == 16_000 and lm_hmm.own_words(1 << 35) == 128_000 and lm_hmm.own_words(1 << 60) == lm_hmm.MOST_WORDS
    texts = [" ".join(f"w{j}" for j in range(i, 70_000, 7)) for i in range(7)] + ["w3 w3 w69999", ""]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, held string")
    got = by_id(lm_hmm.score(d, rounds=0, top=70_000, states=2))
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    h, ptr = lm_hmm.tokens(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    u, c = np.unique(h, return_counts=True)
    kind = (u & np.uint64(3)).astype(int)
    m = lm_hmm.Model(u, c, len(texts), np.bincount(kind, weights=c, minlength=4).astype(int), np.bincount(kind, minlength=4), 2)
    assert m.kind is np.uint32 and m.k == 70_000
    for i in range(len(texts)):
        ids = np.append(m.ids(h[ptr[i] : ptr[i + 1]]), m.end)
        assert got[i].score == pytest.approx(m.forward(ids, np.array([0, len(ids)]))[0] / math.log(10))


@pytest.mark.parametrize("shard_bytes", [100, 1 << 20])
def test_benchmark_item_without_an_id(spark, shard_bytes):
    from rankweave.llm.decontam import decontaminate

    passage = " ".join(WORDS[:20])
    docs = spark.createDataFrame([(1, passage), (2, " ".join(WORDS[100:140])), (3, f"{passage} {' '.join(WORDS[50:70])}")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (7, " ".join(WORDS[50:70])), (None, " ".join(WORDS[200:220]))], "item_id long, text string")
    got = by_id(decontaminate(docs, bench, shard_bytes=shard_bytes))
    assert {i: (r.n_hit, r.hit_items, r.contaminated) for i, r in got.items()} == {1: (20, [], True), 2: (0, [], False), 3: (40, ["7"], True)}
