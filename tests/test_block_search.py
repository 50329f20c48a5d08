"""Search through block bounds against full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    weights = 1 / np.arange(1, 41) ** 1.2
    words = lambda n: " ".join(f"w{i}" for i in rng.choice(40, n, p=weights / weights.sum()))
    rows = [(i, words(int(rng.integers(1, 60))) + (" rare rare rare" if i % 97 == 5 else "")) for i in range(400)] + [(400, ""), (401, None), (402, "twin"), (403, "twin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "w0 w3 w9"), (2, "rare w1"), (3, "rare rare"), (4, "absent"), (5, None), (6, "twin"), (7, "w0")], "query_id long, text string")
    return docs, queries


def _full(rows, k):
    got = {}
    for q, d, s in sorted(rows, key=lambda r: (r[0], -round(r[2], 9), r[1])):
        got.setdefault(q, []).append((d, round(s, 9)))
    return {q: v[:k] for q, v in got.items()}


@pytest.mark.parametrize("method", ["robertson", "lucene"])
def test_equals_full_search(spark, tables, tmp_path, method):
    from rankweave.operators import scoring
    from rankweave.operators.blocksearch import BlockIndex
    from rankweave.operators.index import Index, Params

    docs, queries = tables
    index = Index.build(docs, params=Params(method=method, base_rate=0.05))
    asked = scoring.query_terms(queries)
    built = BlockIndex.build(index, 8).save(str(tmp_path / "blocks"))
    full = scoring.sparse_scores(index, asked).select("query_id", "doc_id", "bm25", "bayes").collect()
    for score in ("bm25", "bayes"):
        for k, first in ((5, 4), (3, 1), (1000, 2)):
            got = [(r.query_id, r.doc_id, r.score) for r in built.search(asked, k, score, first).collect()]
            assert _full(got, k) == _full([(r.query_id, r.doc_id, r[score]) for r in full], k)
        matched = {(r.query_id, r.doc_id): r[score] for r in full}
        bound = {(r.query_id, r.block_id): r.bound for r in built.bounds(asked, score).collect()}
        where = {r.doc_id: r.block_id for r in built.postings.select("doc_id", "block_id").distinct().collect()}
        assert all(s <= bound[q, where[d]] + 1e-12 for (q, d), s in matched.items())
    share = {r.query_id: r for r in built.read_share(asked, 3).collect()}
    assert set(share) == {1, 2, 3, 6, 7}
    if method == "lucene":
        assert share[7].blocks_kept < share[7].blocks and share[7].postings_kept < share[7].postings


def test_ordinals(spark, tables):
    from rankweave.operators.blocksearch import ordinals
    from rankweave.operators.index import Index

    docs, _ = tables
    index = Index.build(docs)
    rows = ordinals(index.docs).collect()
    assert sorted(r.ord for r in rows) == list(range(404))
    by = sorted(rows, key=lambda r: r.ord)
    kind = [int(np.floor(8 * np.log2(1 + max(r.doc_len, 0)))) for r in by]
    assert kind == sorted(kind)
    again = ordinals(index.docs.unionByName(index.docs.limit(7)).repartition(3)).collect()
    assert {(r.doc_id, r.ord) for r in again} == {(r.doc_id, r.ord) for r in rows}


def test_empty_and_wrong(spark, tables):
    from rankweave.operators import scoring
    from rankweave.operators.blocksearch import BlockIndex
    from rankweave.operators.index import Index, Params

    docs, queries = tables
    asked = scoring.query_terms(queries)
    assert BlockIndex.build(Index.build(docs.limit(0))).search(asked, 3).count() == 0
    built = BlockIndex.build(Index.build(docs, params=Params(alpha=-1.0)))
    assert built.search(asked.where(F.lit(False)), 3).count() == 0
    for wrong in ("bayes", "dense"):
        with pytest.raises(ValueError):
            built.search(asked, 3, wrong)


def test_fields_in_one_pass(spark, tables):
    from rankweave.functions.analysis import tokenize
    from rankweave.operators import scoring
    from rankweave.operators.index import Index, Params

    docs, queries = tables
    text = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", F.substring(text, 1, 20).alias("title"), F.expr("substring(coalesce(text, ''), 21)").alias("body"))
    asked, weights, p = scoring.query_terms(queries), {"title": 0.3, "body": 0.7}, Params(base_rate=0.1)
    tokens = parts.select("doc_id", *(tokenize(F.col(f)).alias(f) for f in weights))
    apart = scoring.multi_field_scores({f: Index.build(parts, text=f, params=p) for f in weights}, asked, weights)
    key = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(scoring.field_scores(tokens, asked, weights, p)) == key(apart)
    assert scoring.field_scores(tokens.withColumn("title", F.array().cast("array<string>")), asked, weights, p).count() == 0
    with pytest.raises(ValueError, match='document 5 lacks field "body"'):
        scoring.field_scores(tokens.withColumn("body", F.when(F.col("doc_id") != 5, F.col("body"))), asked, weights, p)
    with pytest.raises(ValueError):
        scoring.field_scores(tokens, asked, {"title": 0.3, "body": 0.9}, p)


@pytest.mark.parametrize("method", ["robertson", "lucene"])
def test_packed_blocks_equal_full_search(spark, tables, monkeypatch, method):
    from rankweave.operators import blocksearch, scoring
    from rankweave.operators.blocksearch import PackedBlocks
    from rankweave.operators.index import Index, Params
    from rankweave.operators.packed import Packed

    docs, queries = tables
    index, asked = Index.build(docs, params=Params(method=method, base_rate=0.05)), scoring.query_terms(queries)
    full = scoring.sparse_scores(index, asked).select("query_id", "doc_id", "bm25", "bayes").collect()
    built = PackedBlocks.of(Packed.of(index, asked))
    assert built.blocks.count() == built.blocks.select("block_id").distinct().count() <= 404 // 8 + 1
    for cells in (1 << 20, 40):
        monkeypatch.setattr(blocksearch, "CELLS", cells)
        for score in ("bm25", "bayes"):
            for k, first in ((5, 4), (3, 1), (1000, 2)):
                got = [(r.query_id, r.doc_id, r.score) for r in built.search(k, score, first).collect()]
                assert _full(got, k) == _full([(r.query_id, r.doc_id, r[score]) for r in full], k)
    for wrong, p in (("dense", {}), ("bayes", {"alpha": -1.0})):
        with pytest.raises(ValueError):
            PackedBlocks.of(Packed.of(Index.build(docs, params=Params(**p)), asked)).search(3, wrong)
    assert PackedBlocks.of(Packed.of(Index.build(docs.limit(0)), asked)).search(3).count() == 0


def test_registered_search_makes_no_rows_of_postings(spark, monkeypatch):
    """Postings of all terms were stored as rows, and joined by term and block, before."""
    import __spark_entry__
    from rankweave.plans import retrieval

    monkeypatch.setattr(retrieval.BlockIndex, "build", lambda *a: pytest.fail("rows of postings"))
    got = __spark_entry__.queries()["block_search_bm25"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 10 * len({r.query_id for r in got}) > 0


def test_registered_search_shuffles_less_than_twice_its_input(spark, tmp_path):
    """On 1 GB it ran out of disk: on these tables the rows of postings and bounds made some twenty times the input in shuffles."""
    import __spark_entry__

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").repartition(4, F.col("text")).write.parquet(f"{tmp_path}/{name}.parquet")

    def written() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    got = __spark_entry__.queries()["block_search_bm25"](spark, str(tmp_path)).collect()
    assert len(got) == 10 * len({r.query_id for r in got}) == 400
    assert written() - before < 2 * sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))


def test_large_query_set_is_searched_in_groups(spark, monkeypatch, tmp_path):
    """Above ``ASKED`` rows of query terms all postings became rows, and bounds a row for each query and block: out of disk."""
    import __spark_entry__
    from rankweave.operators import packed
    from rankweave.plans import retrieval

    run = __spark_entry__.queries()["block_search_bm25"]
    want = sorted(run(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(retrieval.BlockIndex, "build", lambda *a: pytest.fail("rows of postings"))
    sizes, of, get = [], packed.Asked.of, type(spark.conf).get
    monkeypatch.setattr(packed.Asked, "of", lambda queries: sizes.append(queries.count()) or of(queries))
    monkeypatch.setattr(packed, "ASKED", 1000)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    for stores in (None, str(tmp_path)):
        monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: stores if key == "spark.checkpoint.dir" else get(self, key, *a))  # noqa: B023
        sizes.clear()
        assert sorted(run(spark, "/root/testdata/sf0.001").collect()) == want
        assert len(sizes) > 2 and sum(sizes[1:]) == sizes[0] and max(sizes[1:]) <= 1000


def test_groups_hold_each_query_once(spark, tables, monkeypatch):
    from rankweave.operators import blocksearch, packed, scoring
    from rankweave.operators.blocksearch import PackedBlocks
    from rankweave.operators.index import Index
    from rankweave.operators.packed import Packed

    docs, queries = tables
    asked = scoring.query_terms(queries)
    index, key = Index.build(docs), lambda df: sorted((r.query_id, r.term, r.qtf) for r in df.collect())
    whole = _full([(r.query_id, r.doc_id, r.score) for r in PackedBlocks.of(Packed.of(index, asked)).search(5).collect()], 5)
    monkeypatch.setattr(blocksearch, "SENT", 1)  # as few tasks as cores
    found = PackedBlocks.of(Packed.of(index, asked))
    assert found._few(found.blocks.repartition(9), 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert _full([(r.query_id, r.doc_id, r.score) for r in found.search(5).collect()], 5) == whole
    found.release()
    assert not found.blocks.storageLevel.useMemory and not found.packed.docs.storageLevel.useMemory
    for most, parts in ((100, 1), (2, 5)):
        monkeypatch.setattr(packed, "ASKED", most)
        got = list(packed.groups(asked))
        assert sum((key(g) for g in got), []) and sorted(sum((key(g) for g in got), [])) == key(asked)
        assert len(got) <= parts and all(g.count() <= most or len({q for q, _, _ in key(g)}) == 1 for g in got)
    assert list(packed.groups(asked.where("query_id < 0"))) == []
