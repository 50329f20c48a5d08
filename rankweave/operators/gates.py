"""Gates over tables of results: (dataset, method, metric, value[, kind]) against thresholds or another run.

Every gate returns one row for each check; :func:`passed` folds them. Ranking metrics count in
points of a hundred, calibration metrics in units.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("ece", "brier", "samples", "bins")


def metric_name(name: str) -> str:
    """ndcg@10 for NDCG@10, ndcg10, ndcg_cut_10 and ndcg_cut10."""
    low = name.strip().lower()
    m = re.fullmatch(r"(ndcg|map|mrr|recall)(?:@|_cut_?)?(\d+)", low)
    return f"{m[1]}@{m[2]}" if m else low


def scale(metric: str) -> str:
    return "unit" if metric_name(metric) in UNITS else "points"


def tolerance(metric: str) -> float:
    return 0.005 if scale(metric) == "unit" else 0.5


def scaled(value: Column, metric: str) -> Column:
    """A share of one becomes points of a hundred."""
    return value if scale(metric) == "unit" else F.when(F.abs(value) <= 1.0000001, value * 100.0).otherwise(value)


def _method(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def _metric_rows(rows: DataFrame, metric: str) -> DataFrame:
    name = F.lower(F.trim("metric"))
    plain = F.regexp_replace(name, r"^(ndcg|map|mrr|recall)(?:@|_cut_?)?(\d+)$", "$1@$2")
    return rows.where(plain == metric_name(metric)).withColumn("method", _method(F.col("method"))).withColumn("value", scaled(F.col("value").cast("double"), metric))


def averages(rows: DataFrame) -> DataFrame:
    """(dataset, method, metric, value): each dataset's, and the mean over datasets with a null dataset."""
    one = rows.groupBy("dataset", "method", "metric").agg(F.avg("value").alias("value"))
    return one.unionByName(one.groupBy("method", "metric").agg(F.avg("value").alias("value")).withColumn("dataset", F.lit(None).cast("string")))


def failure_class(method: Column, missing: Column, metric: str) -> Column:
    """Where to look when a method departs."""
    if metric_name(metric) in ("ece", "brier"):
        return F.lit("calibration")
    m = _method(method)
    return (
        F.when(missing, "evaluator").when((m == "bm25") | m.contains("raw_bm25"), "tokenizer")
        .when(m.contains("dense"), "embedding").when(m.isin("convex", "rrf") | m.contains("fusion_baseline"), "candidates")
        .when(m.contains("bayesian") | m.contains("balanced") | m.contains("logodds"), "fusion").otherwise("candidates")
    )


def parity(expected: DataFrame, actual: DataFrame, methods: list[str], metric: str = "ndcg@10", within: float | None = None, by_dataset: bool = False) -> DataFrame:
    """(method, dataset, expected, actual, diff, passed, classification) of means, and of datasets if asked for.

    A method that either side lacks fails. Datasets of the expected side that the actual one lacks fail too.
    """
    limit = tolerance(metric) if within is None else within
    spark = expected.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(re.sub(r"[-\s]+", "_", m.strip().lower()),) for m in methods], "method string"))  # the caller's list
    a, b = (averages(_metric_rows(r, metric)).select("method", "dataset", F.col("value").alias(n)) for r, n in ((expected, "expected"), (actual, "actual")))
    both = a.alias("a").join(b.alias("b"), (F.col("a.method") == F.col("b.method")) & F.col("a.dataset").eqNullSafe(F.col("b.dataset")), "full_outer")
    both = both.select(F.coalesce("a.method", "b.method").alias("method"), F.coalesce("a.dataset", "b.dataset").alias("dataset"), "expected", "actual")
    rows = wanted.join(both if by_dataset else both.where("dataset is null"), "method", "left")
    rows = rows.where("expected is not null or dataset is null")
    diff = F.abs(F.col("actual") - F.col("expected"))
    return rows.select("method", "dataset", "expected", "actual", diff.alias("diff"), F.coalesce(diff <= limit, F.lit(False)).alias("passed"), failure_class(F.col("method"), diff.isNull(), metric).alias("classification"))


def ordering(rows: DataFrame, order: list[str], metric: str = "ndcg@10") -> DataFrame:
    """Each method of ``order`` must stand above the next one; pairs that lack a side are left out."""
    mean = averages(_metric_rows(rows, metric)).where("dataset is null").select("method", "value")
    pairs = F.broadcast(rows.sparkSession.createDataFrame(list(zip(order, order[1:], strict=False)), "better string, worse string"))
    a, b = mean.select(F.col("method").alias("better"), F.col("value").alias("better_value")), mean.select(F.col("method").alias("worse"), F.col("value").alias("worse_value"))
    return pairs.join(a, "better").join(b, "worse").withColumn("passed", F.col("better_value") > F.col("worse_value"))


def calibration_gate(rows: DataFrame, datasets: list[str] | None = None, metric: str = "ece", baseline: str = "bayesian_no_base_rate", calibrated: str = "bayesian", fitted: str | None = "bayesian_fitted_split", least: float = 0.5, most: float = 0.02) -> DataFrame:
    """(dataset, check, value, passed): the error falls by the share ``least``, and the fitted one is at most ``most``."""
    got = _metric_rows(rows, metric)
    known = got.select("dataset").distinct()
    if datasets is not None:
        known = got.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    wide = known.join(got.groupBy("dataset").agg(pick(baseline).alias("base"), pick(calibrated).alias("cal"), pick(fitted or "").alias("fit")), "dataset", "left")
    fall = F.when(F.col("base") > 0, (F.col("base") - F.col("cal")) / F.when(F.col("base") > 0, F.col("base"))).when(F.col("cal") <= F.col("base"), 1.0).otherwise(F.when(F.col("cal").isNotNull() & F.col("base").isNotNull(), 0.0))
    checks = [F.struct(F.lit("reduction").alias("check"), fall.alias("value"), F.coalesce(fall >= least, F.lit(False)).alias("passed"))]
    if fitted:
        checks.append(F.struct(F.lit("fitted_threshold").alias("check"), F.col("fit").alias("value"), F.coalesce(F.col("fit") <= most, F.lit(False)).alias("passed")))
    return wide.select("dataset", F.inline(F.array(*checks)))


def hybrid_gate(rows: DataFrame, stored: DataFrame, methods: list[str], metric: str = "ndcg@10", over_bm25: float = 4.0, over_rrf: float = -0.5, near_stored: float = 0.5) -> DataFrame:
    """(method, value, vs_bm25, vs_rrf, vs_stored, passed) of the methods whose ``kind`` is zero-shot; others make no claim."""
    kinds = rows.select(_method(F.col("method")).alias("method"), "kind").distinct()
    mean = averages(_metric_rows(rows, metric)).where("dataset is null").select("method", "value")
    old = averages(_metric_rows(stored, metric)).where("dataset is null").select("method", F.col("value").alias("stored"))
    base = mean.agg(F.max(F.when(F.col("method") == "bm25", F.col("value"))).alias("bm25"), F.max(F.when(F.col("method") == "rrf", F.col("value"))).alias("rrf"))  # one row
    wide = kinds.where((F.col("kind") == "zero-shot") & F.col("method").isin(methods)).join(mean, "method", "left").join(old, "method", "left").crossJoin(base)
    d = {n: F.col("value") - F.col(n) for n in ("bm25", "rrf", "stored")}
    ok = (d["bm25"] >= over_bm25) & (d["rrf"] >= over_rrf) & (F.abs(d["stored"]) <= near_stored)
    return wide.select("method", "value", *(c.alias(f"vs_{n}") for n, c in d.items()), F.coalesce(ok, F.lit(False)).alias("passed"))


def same_protocol(baseline: dict, claim: dict) -> list[tuple[str, bool]]:
    """(check, passed) of two runs' descriptions: datasets, evaluator and metric must agree."""
    names = [set(map(str, r.get("datasets") or [])) for r in (baseline, claim)]
    metrics = [r.get("metric") for r in (baseline, claim)]
    return [
        ("same_inputs", bool(names[0]) and names[0] == names[1]),
        ("same_evaluator", baseline.get("evaluator") is not None and baseline.get("evaluator") == claim.get("evaluator")),
        ("same_metric", all(isinstance(m, str) and m.strip() for m in metrics) and metric_name(metrics[0]) == metric_name(metrics[1])),
    ]


def passed(checks: DataFrame, least: int = 1) -> bool:
    """All checks passed, of which there must be ``least``."""
    got = checks.agg(F.count("*").alias("n"), F.sum((~F.col("passed")).cast("int")).alias("bad")).first()
    return got.n >= least and not got.bad
