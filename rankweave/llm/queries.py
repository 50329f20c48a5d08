"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import decontamination_digest
from .divergence import divergence_digest
from .embed_dedup import embedding_links
from .html_extract import main_texts
from .lm_hmm import scoring_digest
from .mixing import mixing_digest
from .ngram_join import jaccard_classes
from .repetition import quality_digest
from .sa_dedup import repeats_digest
from .stages import run
from .toxicity import toxicity_digest
from .url_filter import url_verdicts
from .vector_codes import compression_digest
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring_digest(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_digest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_digest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_warc_revisits, op2_embedding_near_dedup, op3_ngram_jaccard_join, op4_html_main_text, op5_url_filter, op6_benchmark_decontamination, op7_suffix_array_dedup, op8_toxicity, op9_source_mixing, op10_lm_scoring, op11_quality_rules, op12_source_divergence, op13_vector_codes, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL: dict[str, str] = {}

_SQL["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, least.m AS component_id, v.vec_id = least.m AS kept
FROM v JOIN least ON least.a = v.vec_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL["op1_warc_revisits"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, b, sha1(b) AS x, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS intact
FROM h
"""

_SQL["op3_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b, c = x.n AND c = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
own AS (SELECT a, count(*) AS k, min(b) FILTER (same) AS twin FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_grams, least(d.doc_id, coalesce(own.twin, d.doc_id)) AS class_id, coalesce(own.k, 0) AS n_links, least.m AS component_id, d.doc_id = least.m AS kept
FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN own ON own.a = d.doc_id
"""

_SQL["op6_benchmark_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k + 1:k + least(13, len(w))], ' ') AS s FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 12))) AS k FROM i WHERE len(w) > 0)),
gram AS (SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT doc_id, gram.n, k, item FROM gram JOIN win ON gram.s = win.s AND gram.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS c, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.c, 0) AS n_hit, coalesce(items.c, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.c, 0) > 0 AND 20 * coalesce(words.c, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SQL["op9_source_mixing"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
units(k, unit) AS (SELECT 0, 0::DOUBLE UNION ALL
  SELECT k + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (w * u.unit > 2.0::DOUBLE * source_size), 0)) / sum(w) FILTER (w * u.unit <= 2.0::DOUBLE * source_size) FROM t)
  FROM units u WHERE k < 100),
aim AS MATERIALIZED (SELECT source, source_size, least(w * (SELECT max(unit) FROM units), 2.0::DOUBLE * source_size) AS target FROM t),
j AS MATERIALIZED (SELECT d.doc_id, d.size, a.source, a.source_size, a.target, d.size > greatest(0.03::DOUBLE * a.target, 0.00375::DOUBLE * a.source_size) AS large FROM d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source),
big AS MATERIALIZED (SELECT source, list(struct_pack(size := size, doc_id := doc_id) ORDER BY size DESC, doc_id DESC) AS l, any_value(target / source_size) AS rate FROM j WHERE large GROUP BY source),
step(source, l, rate, i, due, taken, n) AS (SELECT source, l, rate, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM big UNION ALL
  SELECT source, l, rate, i + 1, due + rate * l[i + 1].size, taken + c * l[i + 1].size, c
  FROM (SELECT *, least(greatest(floor((due + rate * l[i + 1].size - taken) / l[i + 1].size + 0.5::DOUBLE), floor(rate)), ceil(rate)) AS c FROM step WHERE i < len(l))),
firm AS (SELECT source, max_by(taken, i) AS firm FROM step GROUP BY source),
rest AS (SELECT source, sum(size) AS s FROM j WHERE NOT large GROUP BY source),
rate AS MATERIALIZED (SELECT a.source, least(greatest((a.target - coalesce(f.firm, 0)) / nullif(r.s, 0), 0::DOUBLE), 2.0::DOUBLE) AS rate,
    ('0x' || substr(md5('0:' || coalesce(a.source, '') || CASE WHEN a.source IS NULL THEN ':null' ELSE ':' END), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM aim a JOIN rest r ON a.source IS NOT DISTINCT FROM r.source LEFT JOIN firm f ON a.source IS NOT DISTINCT FROM f.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS k FROM j WHERE NOT large)
SELECT x.doc_id, x.size, x.source_size, x.target, ((floor(k * coalesce(rate, 0) + u) - floor((k - 1) * coalesce(rate, 0) + u)) * x.size)::BIGINT AS taken FROM ranked x JOIN rate r ON x.source IS NOT DISTINCT FROM r.source
UNION ALL SELECT l[i].doc_id, l[i].size, a.source_size, a.target, (n * l[i].size)::BIGINT FROM step s JOIN aim a ON s.source IS NOT DISTINCT FROM a.source WHERE i > 0
"""

_SQL["op7_suffix_array_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
low AS (SELECT h, min(doc_id) AS m FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s JOIN low USING (h) WHERE m < doc_id),
grp AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
span AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM grp GROUP BY doc_id, g),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
cuts AS (SELECT doc_id, b AS f, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS t FROM span UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
kept AS (SELECT c.doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_SQL["op11_quality_rules"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d),
l AS (SELECT doc_id, i, s, list_sum(list_transform(regexp_extract_all(s, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, count(*)::BIGINT AS n, sum(chars)::BIGINT AS chars FROM (SELECT doc_id, chars, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS k FROM l) WHERE k > 1 GROUP BY doc_id),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([5, 6, 8, 10]) AS n))),
again AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, s) AS c FROM g) WHERE c > 1),
inside AS (SELECT doc_id, n, count(*)::BIGINT AS words, sum(length(w[p]))::BIGINT AS chars FROM (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM again) JOIN d USING (doc_id) GROUP BY doc_id, n),
x AS (SELECT c.*, coalesce(lines.n, 0) AS n_dup_lines, coalesce(lines.chars, 0) AS dup_line_chars, coalesce(i5.words, 0) AS n_repeat_words, coalesce(i5.chars, 0) AS repeat_chars, coalesce(i10.chars, 0) AS long_repeat_chars,
    coalesce(i6.chars, 0) AS c6, coalesce(i8.chars, 0) AS c8
  FROM c LEFT JOIN lines USING (doc_id) LEFT JOIN (SELECT * FROM inside WHERE n = 5) i5 USING (doc_id) LEFT JOIN (SELECT * FROM inside WHERE n = 6) i6 USING (doc_id) LEFT JOIN (SELECT * FROM inside WHERE n = 8) i8 USING (doc_id) LEFT JOIN (SELECT * FROM inside WHERE n = 10) i10 USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (dup_line_chars > 0.3::DOUBLE * word_chars OR repeat_chars > 0.3::DOUBLE * word_chars OR c6 > 0.3::DOUBLE * word_chars OR c8 > 0.28::DOUBLE * word_chars OR long_repeat_chars > 0.25::DOUBLE * word_chars) AS kept,
  dup_line_chars, repeat_chars, long_repeat_chars FROM f
"""

_SQL["op12_source_divergence"] = r"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, k, term, count(*)::BIGINT AS n FROM (SELECT lang, source, k, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS in_lang FROM t GROUP BY lang, term HAVING count(*) >= 10),
own AS MATERIALIZED (SELECT lang, source, term, sum(n)::BIGINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
tot AS MATERIALIZED (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM own o WHERE o.lang = g.lang AND o.source = g.source), 0)::HUGEINT AS own, (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v, coalesce((SELECT sum(in_lang) FROM kept k WHERE k.lang = g.lang), 0)::HUGEINT AS all_n FROM grp g),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (g.own + 2 * g.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.in_lang + 2)) // (g.all_n + 2 * g.v))::BIGINT AS q
  FROM tot g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM best)) WHERE part = 'pair' OR rank <= 10
"""


def _codes_sql() -> str:
    """The rounds written out one after another, all in integers."""
    ctes = ["""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0 AND len(embedding) % 4 = 0)""",
            "x AS MATERIALIZED (SELECT vec_id, label, p, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] AS v FROM k, (SELECT unnest(range(4)) AS p))",
            "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"]
    for r in range(5):
        near = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, o.j AS j, o.d AS d FROM (SELECT x.vec_id, any_value(x.label) AS label, x.p, any_value(x.v) AS v, min(struct_pack(d := {near}, j := b.j)) AS o FROM x JOIN b{r} b ON x.p = b.p GROUP BY x.vec_id, x.p))")
        if r < 4:
            ctes.append(f"m{r} AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT p, j, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT p, j, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, j, i) GROUP BY p, j)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, j))")
    ctes.append("coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)")
    ctes.append("books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b4)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"


_SQL["op13_vector_codes"] = _codes_sql()
