"""The corpus pipeline: toxicity, n-gram Jaccard join, suffix-array dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet to
the shared folder and gives the next stage what it reads back. All stages but the last return the
columns of documents, and leave out any others. No stage fails on an empty table, null in any
column, empty or very long texts, or repeated rows; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import decontaminate
from .mixing import mix
from .ngram_join import one_of_each_group
from .sa_dedup import remove_repeats
from .textcore import drop, scratch, stored
from .toxicity import THRESHOLD, fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a field fitted on the labelled training fold.

    Only texts are scored: null and empty ones stay, and equal texts share a fate. Without labels
    of both classes every text stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs.select(*COLUMNS), fit_toxicity(docs, labels))
    return scored.where(F.col("toxicity") < THRESHOLD).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id.

    Of rows with equal id and text one stays; texts without words and rows with a null id all
    stay, but for such repeats of an id.
    """
    return one_of_each_group(docs.select(*COLUMNS))


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document of smaller id has; what only white space is left of goes.

    Texts that lose nothing stay as they are, null and empty ones too; n_chars is counted anew
    where bytes went. Rows with a null id neither remove nor lose, rows of one id keep each other.
    """
    cut = remove_repeats(docs.select(*COLUMNS))
    lost = F.col("n_removed") > 0
    left = cut.where(~lost | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", F.when(lost, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(lost, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words lie in benchmark windows for less than one in twenty, or not at all; texts without words stay."""
    judged = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy that the mix takes, numbered from 1; rows that share an id have the copies of the most taken."""
    plan = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("mix_id")).agg(F.max("copies").alias("copies"))
    taken = docs.select(*COLUMNS).join(plan, F.col("doc_id").eqNullSafe(F.col("mix_id")))
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("suffix_array", suffix_array), ("decontamination", decontamination), ("mixing", mixing)]

#: Toxicity is a fit and has no SQL; the tests compare the run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves in the shared folder but for its result goes when it is stored, its input when it has been read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark) as written:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            own = [written.pop()]
        drop(spark, before)
        before = own
    return docs
