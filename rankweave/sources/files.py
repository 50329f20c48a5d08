"""Readers and writers of documents, queries, judgments and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import split_terms


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor a comment."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def _terms(raw):
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), F.lit(None).cast("array<string>")).when(raw.startswith("["), listed).otherwise(split_terms(raw))


def _field(name: str):
    return F.get_json_object("value", f"$.{name}")


def read_docs(spark: SparkSession, path: str, *, doc_id: str = "doc_id", text: str = "text", embedding: str = "embedding", terms: str = "terms", fields: str | None = None) -> DataFrame:
    """doc_id, text, terms, embedding (empty where absent), and fields as a map. A missing id is an error."""
    rows = _lines(spark, path)
    key = F.coalesce(_field(doc_id), F.raise_error(F.concat(F.lit("no document id in: "), F.substring("value", 1, 80))).cast("string"))
    cols = [key.alias("doc_id"), F.coalesce(_field(text), F.lit("")).alias("text"), _terms(_field(terms)).alias("terms"), F.coalesce(F.from_json(_field(embedding), "array<double>"), F.array().cast("array<double>")).alias("embedding")]
    if fields:
        listed = F.from_json(_field(fields), "map<string,string>")
        cols.append(F.transform_values(listed, lambda _, v: _terms(v)).alias("fields"))
    return rows.select(*cols)


def read_queries(spark: SparkSession, path: str, *, query_id: str = "query_id", text: str = "text", embedding: str = "embedding", terms: str = "terms") -> DataFrame:
    """query_id, text, terms, embedding; an absent vector stays null, which an empty one is not."""
    return _lines(spark, path).select(_field(query_id).alias("query_id"), F.coalesce(_field(text), F.lit("")).alias("text"), _terms(_field(terms)).alias("terms"), F.from_json(_field(embedding), "array<double>").alias("embedding"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance from JSON lines, or from three or four columns; the last of repeated rows wins.

    Shorter rows are left out, and so is a header; any other relevance that is no number is an error.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("line")).where("value <> '' and not startswith(value, '#')")
    if path.endswith((".jsonl", ".json")):
        rows = rows.select("line", _field("query_id").alias("query_id"), _field("doc_id").alias("doc_id"), F.coalesce(_field("relevance").cast("double"), F.lit(1.0)).alias("relevance"))
    else:
        parts = F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split("value", r"\s+"))
        rows = rows.select("line", parts.alias("p")).where("size(p) >= 3")
        rows = rows.select("line", F.col("p")[0].alias("query_id"), F.when(F.size("p") >= 4, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))).alias("doc_id"), F.when(F.size("p") >= 4, F.get("p", F.lit(3))).otherwise(F.get("p", F.lit(2))).alias("raw"))
        number = F.expr("try_cast(raw as double)")
        first = rows.agg(F.min("line").alias("top"))
        rows = rows.crossJoin(F.broadcast(first)).where(~(number.isNull() & (F.col("line") == F.col("top"))))
        rows = rows.select("line", "query_id", "doc_id", F.coalesce(number, F.raise_error(F.concat(F.lit("no relevance: "), "raw")).cast("double")).alias("relevance"))
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("line"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "doc_id", "relevance")


def write_trec(runs: DataFrame, path: str, depth: int = 1000, tag: str = "rankweave") -> None:
    """runs(scorer, query_id, doc_id, score) as ``qid Q0 did rank score tag``, a folder for each scorer."""
    finite = runs.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    w = Window.partitionBy("scorer", "query_id").orderBy(F.desc("score"), "doc_id")
    ranked = finite.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag))
    ranked.select("scorer", line.alias("value")).write.mode("overwrite").partitionBy("scorer").text(path)


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", r"\s+")
    return spark.read.text(path).select(p[0].alias("query_id"), p[2].alias("doc_id"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"))
