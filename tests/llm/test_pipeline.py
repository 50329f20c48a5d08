"""The pipeline against plain Python, stage by stage."""

import re

import numpy as np

WORDS = [f"t{i}" for i in range(500)]


def test_run(spark, tmp_path):
    import corpus_pipeline as c

    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    rows, labels = [], []
    for i in range(300):
        words = prose(80).split()
        if i % 5 == 0:
            for k in (3, 20, 41, 60):
                words[k] = "vilew"
        rows.append([i, " ".join(words)])
        labels.append((i, 1, int(i % 5 == 0)))
    passage, item = prose(70), prose(30)
    rows += [[400 + i, f"{prose(40)} {passage} {prose(40)}"] for i in range(3)]  # a passage that repeats
    rows += [[500, rows[1][1]], [501, rows[1][1] + " more"]]  # a copy and a near copy
    rows += [[600, f"{prose(20)} {item}"], [601, f"{prose(900)} {item}"]]  # contaminated, and below the limit
    rows += [[700, ""], [701, None]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    from rankweave.llm.textcore import stored

    for name, f in c.STAGES:
        docs = stored(f(spark, docs, str(tmp_path)), name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert name == "mixing" or docs.columns == c.COLUMNS
    texts = dict(rows)
    assert set(kept["toxicity"]) == {i for i in texts if not (i < 300 and i % 5 == 0)}
    assert set(kept["toxicity"]) - set(kept["ngram_jaccard"]) == {500, 501}
    assert kept["suffix_array"][400] == texts[400] and all(passage not in kept["suffix_array"][i] for i in (401, 402))
    assert all(kept["suffix_array"][i] == texts[i] for i in kept["suffix_array"] if i < 300)
    assert set(kept["suffix_array"]) - set(kept["decontamination"]) == {600} and 601 in kept["decontamination"]
    taken = [r for r in c.run(spark, str(tmp_path)).collect()]
    words = lambda t: len(re.findall(r"\S+", t or ""))
    assert abs(sum(words(r.text) for r in taken) - 1.5 * sum(map(words, kept["decontamination"].values()))) < 0.03 * sum(map(words, kept["decontamination"].values()))


def test_odd_tables(spark, tmp_path):
    """Every stage, and the run, on empty tables, nulls, repeated rows and extra columns with clashing names."""
    import corpus_pipeline as c
    from rankweave.llm.textcore import stored

    rng = np.random.default_rng(3)
    long = " ".join(rng.choice(WORDS, 30_000))
    odd = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, None, None, None), (2, None, None, None, None), (None, "\n\t", "en", None, 2), (None, long, "en", "t", 3), (3, "", "", "", 0), (4, long, "en", "u", 4), (5, "x" * 60 + "\n", "en", "s", 61), (6, "x" * 60 + "\t", "en", "s", 61)]
    kind, tables = "doc_id long, text string, lang string, source string, n_chars long", {}
    for name, rows in (("odd", odd), ("none", [])):
        d = tmp_path / name
        df = spark.createDataFrame([(*r, "clash", 7, True) for r in rows], f"{kind}, copies string, toxicity long, kept boolean")
        df.write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, None, 1), (1, 1, None), (None, 1, 1), (4, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([(None, None), (1, ""), (2, "q")] if rows else [], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        docs = spark.read.parquet(str(d / "documents.parquet"))
        for stage, f in c.STAGES:
            out = f(spark, spark.read.parquet(str(d / "documents.parquet")), str(d))
            assert out.columns == (c.COLUMNS + ["copy"] if stage == "mixing" else c.COLUMNS)
            tables[name, stage] = sorted(map(str, stored(out, stage).collect()))
            assert rows or not tables[name, stage]
        assert c.run(spark, str(d)).count() >= 0 and docs.count() == len(rows)
    ids = lambda stage: sorted(re.findall(r"Row\(doc_id=(\w+)", " ".join(tables["odd", stage])))
    assert len(ids("toxicity")) == len(odd) and len(ids("decontamination")) == len(odd)
    assert ids("ngram_jaccard") == sorted(["1", "2", "None", "None", "3", "5"])  # 6 has the one word of 5
    assert ids("suffix_array") == sorted(["1", "1", "2", "2", "None", "None", "3", "5"])  # of 6 a tab is left, of 4 nothing
