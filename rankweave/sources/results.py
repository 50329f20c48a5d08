"""Results that others have written: folders of run files, judged in bulk, and metric tables in JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import judged_means
from .files import read_qrels


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, scorer, query_id, doc_id, score) of all run files below ``path``.

    ``dataset=`` and ``scorer=`` folders give both names, else the file's folder and its name without the
    ending. A line of ``qid Q0 did rank score tag`` needs its six columns, blank lines aside; of repeated
    documents of a query the last counts.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value")).where("value <> ''")
    p = F.split("value", r"\s+")
    named = lambda key, other: F.coalesce(F.nullif(F.regexp_extract("file", f"/{key}=([^/]+)/", 1), F.lit("")), other)
    parts = F.split("file", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    bad = F.raise_error(F.concat(F.lit("no run line: "), "value"))
    score = F.when(F.size(p) < 6, bad.cast("double")).otherwise(F.get(p, F.lit(4)).cast("double"))
    rows = lines.select(named("dataset", F.element_at(parts, -2)).alias("dataset"), named("scorer", stem).alias("scorer"), F.get(p, F.lit(0)).alias("query_id"), F.get(p, F.lit(2)).alias("doc_id"), score.alias("score"), "line")
    return rows.groupBy("dataset", "scorer", "query_id", "doc_id").agg(F.max_by("score", "line").alias("score"))


def judge_runs(spark: SparkSession, runs: str, qrels: dict[str, str], cutoffs: list[int]) -> DataFrame:
    """(scorer, dataset, cutoff, datasets, queries, ndcg, map, mrr, recall) of a folder of run files, judged by a file of
    each data set; a null dataset is the mean over those of a scorer. Ranks come from the scores, not from the files."""
    judged = [read_qrels(spark, path).withColumn("dataset", F.lit(name)) for name, path in qrels.items()]
    return judged_means(read_runs(spark, runs), reduce(DataFrame.unionByName, judged), cutoffs)


# --- metric tables ------------------------------------------------------------------------------


def _got(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is_array(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(_got(v, path, "variant")), F.lit("ARRAY")), F.lit(False))


def _is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(_got(v, path, "variant")), F.lit("OBJECT")), F.lit(False))


def _calibration_map(row: Column) -> Column:
    return F.map_filter(F.create_map(*(x for m in ("ece", "brier", "samples", "bins") for x in (F.lit(m), _got(row, f"$.{m}", "double")))), lambda _, v: v.isNotNull())


def metric_rows(payloads: DataFrame) -> DataFrame:
    """(file, dataset, method, metric, value) of payloads(file, value), a JSON text each, in any of four shapes.

    ``results`` and ``calibration`` lists, an ``average`` list, ``runs`` with lists of either by data set, and objects of
    data set, method and metrics, at the top or under ``results``. What has no data set has ``average``. Where one method of
    a data set is given again, the later shape replaces it; metrics that are no numbers are left out; no JSON is an error.
    """
    v = payloads.select("file", F.parse_json("value").alias("v"))
    col = F.col("v")

    def listed(rows: DataFrame, at: Column, dataset: Column, calibration: bool, turn: int) -> DataFrame:
        got = rows.select("file", dataset.alias("dataset"), F.posexplode(at).alias("pos", "row"))
        row = F.col("row")
        metrics = _calibration_map(row) if calibration else _got(row, "$.metrics", "map<string,variant>")
        if not calibration:
            metrics = F.transform_values(metrics, lambda _, x: _got(x, "$", "double"))
        return got.select("file", "dataset", _got(row, "$.scorer", "string").alias("method"), F.lit(turn).alias("turn"), "pos", metrics.alias("metrics"))

    every = F.lit("average")
    parts = [listed(v, _got(col, f"$.{name}", "array<variant>"), every, name == "calibration", i) for i, name in enumerate(("results", "calibration", "average"))]
    runs = v.select("file", F.explode(_got(col, "$.runs", "array<variant>")).alias("v"))
    dataset = F.coalesce(_got(col, "$.dataset", "string"), F.lit("dataset"))
    parts += [listed(runs, _got(col, f"$.{name}", "array<variant>"), dataset, name == "calibration", 3 + i) for i, name in enumerate(("results", "calibration"))]
    below = _is_object(col, "$.results") & ~_is_array(col, "$.runs")
    tables = v.select("file", F.when(below, _got(col, "$.results", "variant")).otherwise(col).alias("v")).where(~_is_array(col, "$.results") & ~_is_array(col, "$.runs"))
    for name in ("dataset", "method"):  # two levels of objects; lists and scalars beside them are no tables
        tables = tables.select("*", F.explode(_got(col, "$", "map<string,variant>")).alias(name, "below")).where(_is_object(F.col("below"), "$")).drop("v").withColumnRenamed("below", "v")
    metrics = F.transform_values(_got(col, "$", "map<string,variant>"), lambda _, x: _got(x, "$", "double"))
    parts.append(tables.select("file", "dataset", "method", F.lit(5).alias("turn"), F.lit(0).alias("pos"), metrics.alias("metrics")))
    rows = reduce(DataFrame.unionByName, parts).where("method is not null")
    last = rows.groupBy("file", "dataset", "method").agg(F.max_by("metrics", F.struct("turn", "pos")).alias("metrics"))
    return last.select("file", "dataset", "method", F.explode("metrics").alias("metric", "value")).where("value is not null")


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """:func:`metric_rows` of the JSON files at ``path``, each a file of its own."""
    files = spark.read.text(path, wholetext=True)
    return metric_rows(files.select(F.col("_metadata.file_path").alias("file"), "value"))
