"""Main-text extraction with a site style tree.

Pages are parsed leniently into blocks that know their chain of elements. The same-host pages
(each distinct page once) are merged into one tree: a node is a chain of tags and classes, its
presentation is the sequence of its children, its content the text directly in it. The entropy
of either over the host's pages, in the logarithm of their number, is 0 if all pages agree and
1 if all differ. A node's importance is the entropy of its presentation times the mean entropy
of the contents below it, a branch's that of its most important node.

From the root down, a branch whose importance is below ``ratio`` of its most important sibling's
is layout and goes, and a node whose own importance is at least ``own`` of what is most important
in it is no skeleton but the main content. The entropies of siblings share one logarithm, so their ratio does not depend on
the number of pages. Nodes whose contents hardly vary go wherever they stand. Inside the main
content, what varies as it does (reader comments, forms, notices) goes by what elements declare;
so does all of a page that has no node of the tree, or of a host with fewer than ``min_pages``.

The tree is a table of counts by (host, node), summed map-side, so a host with a third of all
pages is no larger than its templates. Its verdicts go to every task if they are few, else
they are joined by host, and a hot host's pages may be split.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import apart, small_batches, stored, tidy

MIN_PAGES = 8
#: Mean content entropy below which a node is template wherever it stands.
LOW = 0.2
#: Share of the most important sibling's importance below which a branch is layout; and the importance from which siblings are compared.
RATIO, LEAST = 0.75, 0.05
#: Share of a branch's importance that its top node itself must have to be main content.
OWN = 0.3
#: Judged nodes that are broadcast; beyond it they are joined by host.
BROADCAST_NODES = 200_000

# Element names by role in HTML, and the words by which sites name their parts.
_RAW = frozenset("script style noscript template iframe xmp textarea title noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_UNSEEN = frozenset("script style noscript template button select textarea iframe svg object canvas audio video head title datalist noembed noframes xmp".split())
_GONE = frozenset("nav footer aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail footer header masthead topbar toolbar comment comments disqus replies respond discussion share sharing social related recommended recommendations widget widgets pagination pager skip copyright disclaimer form searchform searchbox paywall".split())
_NOT_FIRST = frozenset("with has no without is js".split())
_CONTENT = frozenset("articlebody article-body article-content article-text entry-content post-content post-body story-body story-content page-content main-content".split())
_HEADED = frozenset("article entry post story content title".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - 2**63


class _Element:
    """An element; ``unseen`` text is never read, and ``gone`` says that it or what holds it declares a side role."""

    __slots__ = ("children", "gone", "inside", "node", "parent", "tag", "unseen")

    def __init__(self, tag: str, node: int, parent: _Element | None, unseen: bool, gone: bool, inside: int):
        self.tag, self.node, self.parent, self.unseen, self.gone, self.inside = tag, node, parent, unseen, gone, inside
        self.children: list[str] = []


class Block:
    """Text between block boundaries: its element, its share of link text."""

    __slots__ = ("element", "links", "text")

    def __init__(self, element: _Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


def _named_out(names: str, inside: int, tag: str) -> bool:
    for name in names.split():
        words = [w for w in _PART.split(_CAMEL.sub("-", name).lower()) if w]
        if not words or words[0] in _NOT_FIRST:
            continue
        found = _NAMES.intersection(words)
        if found - {"header"} or (found and not (inside and _HEADED.intersection(words))):
            return True
    return False


def _opened(tag: str, raw: str, parent: _Element) -> _Element:
    attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}
    cls, own_id, role = attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", "").lower()
    inside = parent.inside
    side = tag in _GONE or (tag == "header" and not inside) or role in _ROLES
    if tag not in ("html", "body", "main"):
        side = side or _named_out(f"{cls} {own_id}", inside, tag)
    unseen = parent.unseen or tag in _UNSEEN or (side and tag not in _BLOCK)
    unseen = unseen or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
    if tag == "article":
        inside = 2
    elif not inside and (tag == "main" or role == "main" or attrs.get("itemprop", "").lower() == "articlebody" or _CONTENT.intersection(cls.lower().split()) or own_id.lower() in _CONTENT):
        inside = 1
    label = f"{tag}.{'.'.join(sorted(cls.lower().split()))}" if cls else tag
    parent.children.append(label)
    return _Element(tag, _hash(str(parent.node), label), parent, unseen, parent.gone or side, inside)


def _space(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def parse(source: str | None) -> list[Block]:
    """The blocks of a page in order, whatever their elements declare."""
    source = source or ""
    at = root = _Element("", 0, None, False, False, 0)
    blocks: list[Block] = []
    held: list[str] = []
    links, in_link, pos, n = 0, 0, 0, len(source)

    def flush() -> None:
        nonlocal links
        if held:
            text = _space(held)
            if text:
                blocks.append(Block(at, text, links))
            held.clear()
            links = 0

    while pos < n:
        lt = source.find("<", pos)
        m = _TOKEN.match(source, lt) if lt >= 0 else None
        if lt < 0 or lt > pos or m is None:
            end = n if lt < 0 else lt if lt > pos else lt + 1
            piece = source[pos:end]
            if not at.unseen:
                held.append(piece)
                if in_link:
                    links += len(piece)
            pos = end
            continue
        pos = m.end()
        closing, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            e = at
            while e is not root and e.tag != tag:
                e = e.parent
            if tag == "a":
                in_link = 0
            if e is not root:
                if tag in _BLOCK or any_block(at, e):
                    flush()
                at = e.parent
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            flush()
            shut = {"p"} if tag not in ("li", "dd", "dt", "tr", "td", "th", "option") else {"p", tag} | ({"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th", "tr") else set())
            e = at
            while e is not root and e.tag not in ("div", "article", "section", "body", "ul", "ol", "dl", "table", "main", "blockquote", "nav", "aside", "header", "footer", "form"):
                if e.tag in shut:
                    at = e.parent
                e = e.parent
        elif tag in ("br", "wbr"):
            if tag == "br" and not at.unseen:
                held.append(" ")
            continue
        if tag in _VOID:
            continue
        e = _opened(tag, raw, at)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, pos)
            pos = end.end() if end else n
            continue
        if raw.endswith("/") and tag not in _BLOCK:
            continue
        at = e
        if tag == "a":
            in_link = 1
    flush()
    return blocks


def any_block(low: _Element, high: _Element) -> bool:
    while low is not high:
        if low.tag in _BLOCK:
            return True
        low = low.parent
    return False


def declared(blocks: list[Block]) -> list[Block]:
    """The blocks that no declared role removes; if any stands in an article (or else a main part), only those."""
    blocks = [b for b in blocks if not b.element.gone]
    for level in (2, 1):
        own = [b for b in blocks if b.element.inside >= level]
        if own:
            return own
    run: list[Block] = []
    out: list[Block] = []
    for b in [*blocks, None]:  # without such a part, three link blocks or more in a row are a menu
        if b is not None and b.links >= 0.8 * len(b.text):
            run.append(b)
            continue
        out += run if len(run) < 3 else []
        run = []
        if b is not None:
            out.append(b)
    return out


#: Verdicts on a node: its branch is layout, it is main content, its contents hardly vary.
_SIDE, _MAIN, _SAME = 1, 2, 4


def main_blocks(blocks: list[Block], verdicts: dict[int, int], roles: bool = True) -> list[Block]:
    """The blocks in main content by the tree's verdicts, else by declared roles; a verdict that leaves nothing is not followed."""
    main, varied = [], []
    for x in blocks:
        seen, goes = 0, False
        for node in reversed(_chain(x.element)):
            v = verdicts.get(node, 0)
            goes = goes or bool(v & _SAME) or bool(v & _SIDE and not seen & _MAIN)
            seen |= v
        if not goes and seen & _MAIN and not (roles and x.element.gone):
            main.append(x)
        if not goes:
            varied.append(x)
    return main or (declared(varied) or declared(blocks) if roles else varied or blocks)


def _chain(e: _Element) -> list[int]:
    out = []
    while e.parent is not None:
        out.append(e.node)
        e = e.parent
    return out


_NODES = "host string, page long, nodes array<struct<chain:array<long>,style:long,content:long>>"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("chain", pa.list_(pa.int64())), ("style", pa.int64()), ("content", pa.int64())]))
    for b in batches:
        pages, nodes = [], []
        for source in b.column("html").to_pylist():
            blocks = parse(source)
            seen: dict[int, tuple[_Element, list[str], list[str]]] = {}
            passed: set[int] = set()
            for x in blocks:
                e, text = x.element, x.text
                while e.parent is not None:
                    own = seen.setdefault(e.node, (e, [], []))
                    if text is not None:
                        own[2].append(text)
                        text = None
                    elif id(e) in passed:
                        break
                    if id(e) not in passed:
                        passed.add(id(e))
                        own[1].extend([*e.children, "|"])
                    e = e.parent
            pages.append(_hash(*(x.text for x in blocks)))
            nodes.append([{"chain": _chain(e), "style": _hash(*style), "content": _hash(*content) if content else None} for e, style, content in seen.values()])
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(pages, pa.int64()), pa.array(nodes, kind)], names=["host", "page", "nodes"])


def style_tree(pages: DataFrame, *, min_pages: int = MIN_PAGES, ratio: float = RATIO, own: float = OWN, least: float = LEAST, low: float = LOW) -> DataFrame:
    """The sites' nodes from rows (host, html): host, node, pages, presentation and content entropies, importance, branch, verdict.

    Equal pages of a host count once; nodes on fewer than ``min_pages`` pages are left out.
    """
    once = pages.select("host", "html").mapInArrow(tidy(_survey), _NODES).dropDuplicates(["host", "page"])
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("x.style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("x.content").alias("value")))).alias("v")
    rows = once.select("host", F.explode("nodes").alias("x")).select("host", F.col("x.chain").alias("chain"), both).where("v.value is not null")
    counts = rows.groupBy("host", F.col("chain")[0].alias("node"), F.col("v.kind").alias("kind"), F.col("v.value").alias("value")).agg(F.count("*").alias("c"), F.first("chain").alias("chain"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    sums = counts.groupBy("host", "node").agg(F.first("chain").alias("chain"), *(of(k, x).alias(f"{n}{k}") for k in (0, 1) for n, x in (("m", F.col("c")), ("cl", F.col("c") * F.ln("c")))))
    # - sum p log_m p, with p = c / m
    h = lambda k: F.when(F.col(f"m{k}") > 1, (F.ln(f"m{k}") - F.col(f"cl{k}") / F.col(f"m{k}")) / F.ln(f"m{k}")).otherwise(1.0)
    nodes = stored(sums.where(F.col("m0") >= min_pages).select("host", "node", "chain", F.col("m0").alias("pages"), h(0).alias("style"), F.when(F.col("m1") > 0, h(1)).alias("content"), F.coalesce("m1", F.lit(0)).alias("m1")), "site-nodes")
    up = nodes.select("host", F.explode("chain").alias("node"), "content", "m1")
    leaves = up.groupBy("host", "node").agg((F.sum(F.col("content") * F.col("m1")) / F.sum(F.when(F.col("content").isNotNull(), F.col("m1")))).alias("leaves"))
    weighed = stored(nodes.join(leaves, ["host", "node"]).withColumn("importance", F.col("style") * F.coalesce("leaves", F.lit(0.0))), "site-importance")
    branch = weighed.select("host", F.explode("chain").alias("node"), "importance").groupBy("host", "node").agg(F.max("importance").alias("branch"))
    judged = weighed.join(branch, ["host", "node"]).withColumn("parent", F.coalesce(F.get("chain", F.lit(1)), F.lit(0).cast("long")))
    most = judged.groupBy("host", "parent").agg(F.max("branch").alias("most"))
    side = (F.col("most") >= least) & (F.col("branch") < ratio * F.col("most"))
    main = (F.col("branch") >= least) & (F.col("importance") >= own * F.col("branch"))
    verdict = F.when(side, _SIDE).otherwise(0) + F.when(main, _MAIN).otherwise(0) + F.when(F.col("leaves") < low, _SAME).otherwise(0)
    return judged.join(most, ["host", "parent"]).select("host", "node", "pages", "style", "content", "importance", "branch", verdict.alias("verdict"))


def extract(pages: DataFrame, *, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, ratio: float = RATIO, own: float = OWN, least: float = LEAST, low: float = LOW, roles: bool = True, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``pages`` without html, with text (the main text's blocks joined by newlines) and n_chars.

    A null html is an empty page and has an empty text. Pages without a host form no site, and
    declared roles alone remove their blocks; with ``roles`` off, only the tree removes any. If the
    tree would remove all of a page, roles decide on it. Rows repeat as they are given, and no
    rows give no rows; columns of these names in ``pages`` are replaced.
    """
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    host = F.lower(F.regexp_extract(F.col(url).cast("string"), r"(?s)://([^/?#]*)", 1))
    rows = pages.select(*rest, F.coalesce(host, F.lit("")).alias("_host"), F.col(html).cast("string").alias("_html"))
    tree = style_tree(rows.where("_host <> ''").select(F.col("_host").alias("host"), F.col("_html").alias("html")), min_pages=min_pages, ratio=ratio, own=own, least=least, low=low)
    nodes = tree.where("verdict > 0").groupBy(F.col("host").alias("_site")).agg(F.collect_list(F.struct("node", "verdict")).alias("_verdicts"))  # the host's templates, not its pages
    nodes = stored(nodes, "site-verdicts")
    if (nodes.agg(F.sum(F.size("_verdicts"))).first()[0] or 0) <= broadcast_nodes:
        rows = rows.join(F.broadcast(nodes), F.col("_host") == F.col("_site"), "left")
    else:
        rows = rows.withColumn("_key", apart(F.xxhash64("_host"))).join(nodes.withColumn("_at", apart(F.xxhash64("_site"))), (F.col("_key") == F.col("_at")) & (F.col("_host") == F.col("_site")), "left").drop("_key", "_at")
    rows = rows.drop("_site", "_host")
    kind = rows.drop("_html", "_verdicts").select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, verdicts in zip(b.column("_html").to_pylist(), b.column("_verdicts").to_pylist(), strict=True):
                blocks = main_blocks(parse(source), {v["node"]: v["verdict"] for v in verdicts or ()}, roles)
                texts.append("\n".join(x.text for x in blocks))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=[*rest, "text", "n_chars"])

    return rows.mapInArrow(tidy(run), kind)


def main_texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
