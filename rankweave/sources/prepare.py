"""Collections for the engine: records to documents, queries and judgments, a sample, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stemming import TOKENIZERS


def prepare_docs(records: DataFrame, *, doc_id: str = "doc_id", tokenizer: str = "none") -> DataFrame:
    """doc_id, text, fields (title and body), and with a tokenizer terms and field_terms.

    The text joins what there is of title, text, body and abstract; the body field is the first of the last three.
    """
    has = [c for c in ("title", "text", "body", "abstract") if c in records.columns]
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    rest = [full(c) for c in has if c != "title"]
    body, title = F.coalesce(*rest, F.lit("")), F.coalesce("title", F.lit("")) if "title" in has else F.lit("")
    out = records.select(F.col(doc_id).cast("string").alias("doc_id"), F.trim(F.concat_ws(" ", *(full(c) for c in has))).alias("text"), F.create_map(F.lit("title"), title, F.lit("body"), body).alias("fields"))
    if tokenizer == "none":
        return out
    made = TOKENIZERS[tokenizer]
    field = lambda n: made(F.col("fields")[n])
    return out.select("*", made(F.col("text")).alias("terms"), F.create_map(F.lit("title"), field("title"), F.lit("body"), field("body")).alias("field_terms"))


def prepare_queries(records: DataFrame, *, query_id: str = "query_id", text: str = "text", tokenizer: str = "none") -> DataFrame:
    out = records.select(F.col(query_id).cast("string").alias("query_id"), F.trim(F.coalesce(text, F.lit(""))).alias("text"))
    return out if tokenizer == "none" else out.withColumn("terms", TOKENIZERS[tokenizer](F.col("text")))


def prepare_qrels(qrels: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Judgments whose document and query both exist."""
    rows = qrels.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("relevance").cast("double").alias("relevance"))
    return rows.join(docs.select("doc_id"), "doc_id", "left_semi").join(queries.select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "relevance")


def from_questions(rows: DataFrame, per_context: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(question_id, question, context) to docs, queries and qrels.

    Equal contexts are one document, known by their hash; each keeps its first ``per_context``
    questions by id, and only documents with a question stay, so all three come of the same rows.
    """
    w = Window.partitionBy("context").orderBy("question_id")
    kept = rows.where("context is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_context)
    kept = kept.withColumn("doc_id", F.concat(F.lit("c"), F.substring(F.sha2("context", 256), 1, 16)))
    docs = kept.groupBy("doc_id").agg(F.first("context").alias("text"))
    return docs, kept.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), kept.select(F.col("question_id").alias("query_id"), "doc_id", F.lit(1.0).alias("relevance"))


def write_collection(docs: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """docs.jsonl and queries.jsonl as JSON lines, qrels.tsv in four columns; each a folder of parts, as :mod:`files` reads."""
    docs.write.mode("overwrite").json(f"{path}/docs.jsonl")
    queries.write.mode("overwrite").json(f"{path}/queries.jsonl")
    line = F.concat_ws("\t", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("string"))
    qrels.select(line.alias("value")).write.mode("overwrite").text(f"{path}/qrels.tsv")


def sample(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tiny collection to try things on: docs, queries and qrels over eight topics.

    Document and query vectors point at their topic, documents with a little of the next one.
    """
    topics = ["index structures", "vector search", "query parsing", "score calibration", "stream windows", "join planning", "column storage", "cache eviction"]
    axis = lambda i, tilt: [1.0 if j == i else tilt if j == (i + 1) % 8 else 0.0 for j in range(8)]
    docs = [(f"d{i}{k}", f"{t} {extra} {topics[(i + 1) % 8].split()[0]}", axis(i, 0.1 * (k + 1))) for i, t in enumerate(topics) for k, extra in enumerate(("basics", "in practice at scale", "measured and compared"))]
    queries = [(f"q{i}", t, axis(i, 0.0)) for i, t in enumerate(topics)]
    qrels = [(f"q{i}", f"d{i}{k}", float(3 - k)) for i in range(8) for k in range(3)]
    return spark.createDataFrame(docs, "doc_id string, text string, embedding array<double>"), spark.createDataFrame(queries, "query_id string, text string, embedding array<double>"), spark.createDataFrame(qrels, "query_id string, doc_id string, relevance double")
