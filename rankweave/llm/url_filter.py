"""URL filtering by rules and by a path-template tree learnt from the rules' verdicts.

All of it is DataFrame work on counts: the pages are first summed by host and path shape, so a
host with a third of all rows is a few rows from then on. Per host the tree is generalised
from the root down, level by level, to whatever depth its paths branch:

1. Numbers, hashes and dates are wildcards at once. A node with more than ``fan_out`` different
   literal children becomes one wildcard if they are mostly rare (few different paths below
   each), or in any case if they are ``wide`` times as many.
2. Sibling branches merge where they are statistically alike. Siblings with the same most
   frequent shape below are pooled, and one whose distribution of shapes agrees with its pool's
   by Hoeffding's bound joins it. Siblings whose block rate is off their pool's by a test of
   proportions merge with those off to the same side. A sibling without any
   labelled row is held to the shapes alone, and so comes under the labels of its kin.

A template's share of blocked rows among those that rules have judged is smoothed towards the
share of the same template over all hosts, itself smoothed towards one half. Templates with
labelled rows on their own host are rejected when it exceeds ``reject``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import apart, stored

FAN_OUT = 30
#: Paths below each child, on average, under which many children are rare; fan-outs that are wildcards whatever is below.
RARE, WIDE = 4.0, 10
SMOOTHING = 4.0
REJECT = 0.5
#: What stands for a segment of a kind.
KINDS = ("{n}", "{date}", "{hex}", "{code}")
#: Probability that Hoeffding's bound parts two branches that are alike; standard errors by which block rates are apart.
ALIKE, Z = 0.05, 1.64
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    ok = url.isNotNull() & (F.instr(url, "://") > 0)
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(ok, lowered).otherwise(""), F.when(ok, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written host + path, and its verdict; nulls without one.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of
    equal length the one with the longer host, then the first, wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, (h, p, v) in sorted(enumerate(rules), key=lambda r: (len(r[1][0] + r[1][1]), len(r[1][0]), -r[0])):
        fits = ((host == h) | host.endswith("." + h)) & (path.startswith(p) if p != "/" else (path.startswith("/")))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """Numbers, hex strings, dates and mixed codes are wildcards; other segments stay literal."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("{n}."), F.substring_index(segment, ".", -1)))
        .when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), "{hex}")
        .when(F.length(F.regexp_replace(segment, "[^0-9]", "")) >= 3, "{code}")
        .otherwise(segment)
    )


def segments(path: Column) -> Column:
    """The path's segments by shape, none for a path without any; slashes in a row count once."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/+")
    return F.when(path.rlike("[^/]"), F.transform(parts, shape)).otherwise(F.array().cast("array<string>"))


def _hoeffding(n: Column, m: Column) -> Column:
    return F.lit(math.sqrt(math.log(2 / ALIKE) / 2)) * (1 / F.sqrt(n) + 1 / F.sqrt(m))


def _from(rest: str, first: Column | int) -> Column:
    return F.slice(rest, first, F.greatest(F.size(rest), F.lit(1)))


def _widened(tree: DataFrame, fan_out: int) -> DataFrame:
    """Literal children of nodes with too many of them as one wildcard."""
    literal = ~F.col("first").isin(*KINDS)
    kids = tree.where(literal).groupBy("host", "head", "first").agg(F.sum("paths").alias("p")).groupBy("host", "head").agg(F.count("*").alias("kids"), F.sum("p").alias("p"))
    wide = kids.where((F.col("kids") > fan_out) & ((F.col("p") < RARE * F.col("kids")) | (F.col("kids") > WIDE * fan_out))).select("host", "head", F.lit(True).alias("wide"))
    return tree.join(wide, ["host", "head"], "left").withColumn("first", F.when(F.col("wide") & literal, "*").otherwise(F.col("first"))).drop("wide")


def _merged(tree: DataFrame) -> DataFrame:
    """``tree`` with ``branch``, the name of each first segment's merged branch."""
    below = F.concat_ws("/", F.transform(_from("rest", 2), lambda x: F.when(x.isin(*KINDS), x).otherwise("w")))
    rows = tree.select("host", "head", "first", F.xxhash64(below).alias("sig"), "paths", "judged", "blocked")
    cells = rows.groupBy("host", "head", "first", "sig").agg(*(F.sum(c).alias(c) for c in ("paths", "judged", "blocked")))
    child = cells.groupBy("host", "head", "first").agg(F.max_by("sig", F.struct("paths", "sig")).alias("top"), *(F.sum(c).alias(c) for c in ("paths", "judged", "blocked")))
    pool = child.groupBy("host", "head", "top").agg(*(F.sum(c).alias(f"all_{c}") for c in ("paths", "judged", "blocked")))
    known = child.join(pool, ["host", "head", "top"])
    # the largest gap between a child's shares of shapes and its pool's: shapes of the child against the pool's
    of_pool = cells.select("host", "head", "first", "sig", F.col("paths").alias("c")).join(known.select("host", "head", "first", "top", "paths", "all_paths"), ["host", "head", "first"])
    shares = of_pool.groupBy("host", "head", "top", "sig").agg(F.sum("c").alias("pool_c"))
    own = of_pool.join(shares, ["host", "head", "top", "sig"]).groupBy("host", "head", "first").agg(
        F.max(F.abs(F.col("c") / F.col("paths") - F.col("pool_c") / F.col("all_paths"))).alias("gap"),
        F.sum(F.col("pool_c") / F.col("all_paths")).alias("shared"),
    )
    known = known.join(own, ["host", "head", "first"])
    gap = F.greatest(F.col("gap"), 1 - F.col("shared"))  # what the pool has and the child has not, taken together
    fits = gap <= _hoeffding(F.col("paths"), F.col("all_paths"))
    q = (F.col("all_blocked") + 1) / (F.col("all_judged") + 2)
    over = F.col("blocked") - F.col("judged") * q
    off = F.when(F.abs(over) > Z * F.sqrt(F.col("judged") * q * (1 - q)), F.signum(over)).otherwise(0.0)  # no labels: not off
    group = F.when(fits, F.concat_ws(":", F.col("top").cast("string"), off.cast("int").cast("string"))).otherwise(F.concat(F.lit("="), "first"))
    named = known.select("host", "head", "first", group.alias("group"))
    names = named.groupBy("host", "head", "group").agg(F.array_sort(F.collect_set("first")).alias("names"))  # WIDE * fan_out literals at most, and the shapes
    branch = F.when(F.size("names") > 1, F.concat(F.lit("("), F.concat_ws("|", "names"), F.lit(")"))).otherwise(F.col("names")[0])
    return tree.join(named.join(names, ["host", "head", "group"]).select("host", "head", "first", branch.alias("branch")), ["host", "head", "first"], "left")


def learn_templates(urls: DataFrame, *, fan_out: int = FAN_OUT, smoothing: float = SMOOTHING, reject: float = REJECT) -> DataFrame:
    """From rows of (host, path, judged, blocked) the templates by path shape.

    host, shape, template, n, judged, blocked, purity (smoothed share of blocked), rejected; one
    row per host and shape. ``judged`` and ``blocked`` are 0 or 1 for each row.
    """
    got = urls.select("host", "path", segments(F.col("path")).alias("rest"), "judged", "blocked")
    once = got.groupBy("host", "rest", "path").agg(F.count("*").alias("n"), F.sum("judged").alias("judged"), F.sum("blocked").alias("blocked"))
    base = once.groupBy("host", "rest").agg(F.sum("n").alias("n"), F.count("*").alias("paths"), F.sum("judged").alias("judged"), F.sum("blocked").alias("blocked"))
    tree = stored(base.withColumns({"shape": F.concat_ws("/", "rest"), "head": F.lit("")}), "url-shapes")
    ended: list[DataFrame] = []
    while not tree.isEmpty():
        # what all shapes below a node begin with is passed over in one step; a node with one rest below it ends
        node = tree.groupBy("host", "head").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        differs = F.array_position(F.zip_with("low", "high", lambda x, y: (~x.eqNullSafe(y)).cast("int")), 1)
        node = node.select("host", "head", F.when(F.col("low") == F.col("high"), F.size("low")).otherwise(differs.cast("int") - 1).alias("common"))
        step = tree.join(node, ["host", "head"])
        passed = F.when(F.col("common") > 0, F.concat(F.lit("/"), F.concat_ws("/", F.slice("rest", 1, F.col("common"))))).otherwise("")
        step = stored(step.withColumns({"head": F.concat("head", passed), "rest": _from("rest", F.col("common") + 1)}).drop("common"), "url-nodes")
        ended.append(step.where(F.size("rest") == 0).select("host", "shape", F.col("head").alias("template"), "n", "judged", "blocked"))
        wide = stored(_widened(step.where(F.size("rest") > 0).withColumn("first", F.col("rest")[0]), fan_out), "url-wide")
        tree = stored(_merged(wide).select("host", "shape", F.concat("head", F.lit("/"), "branch").alias("head"), _from("rest", 2).alias("rest"), "n", "paths", "judged", "blocked"), "url-merged")
    if not ended:
        return tree.selectExpr("host", "shape", "head AS template", "n", "judged", "blocked", "0D AS purity", "false AS rejected")
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    by_host = out.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "judged", "blocked")))
    over_all = by_host.groupBy("template").agg(((F.sum("blocked") + smoothing / 2) / (F.sum("judged") + smoothing)).alias("prior"))
    by_host = by_host.withColumn("k", apart(F.xxhash64("template"))).join(over_all.withColumnRenamed("template", "t").withColumn("tk", apart(F.xxhash64("t"))), (F.col("k") == F.col("tk")) & (F.col("template") == F.col("t")))
    purity = (F.col("blocked") + smoothing * F.col("prior")) / (F.col("judged") + smoothing)
    judged = by_host.select("host", "template", "n", "judged", "blocked", purity.alias("purity"), ((F.col("judged") > 0) & (purity > reject)).alias("rejected"))
    return out.select("host", "shape", "template").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, *, url: str = "url", rules=RULES, fan_out: int = FAN_OUT, smoothing: float = SMOOTHING, reject: float = REJECT) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict.

    The rule decides where one fits, else the page's template: block if it is rejected. A null
    url, or one without ``://``, has an empty host and path and is allowed as long as no rule says
    otherwise; repeated rows count each, but as one path; no rows give no rows; columns of these
    names in ``pages`` are replaced.
    """
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.drop(*[c for c in made if c != url]).withColumns({"_host": host, "_path": path})
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": name, "_ruled": verdict})
    keyed = rows.withColumn("_shape", F.concat_ws("/", segments(F.col("_path"))))
    urls = rows.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_ruled").isNotNull().cast("long").alias("judged"), F.coalesce(F.col("_ruled") == "block", F.lit(False)).cast("long").alias("blocked"))
    known = learn_templates(urls, fan_out=fan_out, smoothing=smoothing, reject=reject).select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "purity", "rejected")
    known = stored(known, "url-templates").withColumn("t_key", apart(F.xxhash64("t_host", "t_shape")))
    out = keyed.withColumn("_key", apart(F.xxhash64("_host", "_shape"))).join(known, (F.col("_key") == F.col("t_key")) & (F.col("_host") == F.col("t_host")) & (F.col("_shape") == F.col("t_shape")), "left")
    rest = [c for c in rows.columns if not c.startswith("_")]
    return out.select(*rest, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), "template", "purity", F.coalesce("_ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))


def url_verdicts(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
