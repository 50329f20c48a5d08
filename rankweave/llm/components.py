"""Connected components of an edge table by alternating large and small stars.

Each round only ever joins edges with one row per node, so a hub with most of the
edges is a skewed side that adaptive execution splits. Nothing is collected; each round's
edges are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import apart, shared_path


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs(u, v) with m, the least of u's row in ``least``."""
    left = pairs.withColumn("k", apart("u"))
    right = least.select(apart("u").alias("k"), "m")
    return left.join(right, "k").select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes in ``edges``; component is the smallest node reachable.

    Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    base = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    path, seen = shared_path(spark, "stars"), None
    for turn in range(200):
        base.write.parquet(f"{path}/{turn}")
        now = spark.read.schema(base.schema).parquet(f"{path}/{turn}")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.toDF("u", "v"), least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = _with_least(large, low)
        base = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    raise RuntimeError("components did not settle")


def linked_classes(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Of classes(id, least, copies) and found(id, n, root): id, n_links, component_id, component.

    A row of ``found`` says that a unit of work linked ``id`` with n rows of other classes
    (copies counted), and that ``root`` is connected with it. n_links also counts the other
    copies of the class; component_id is the least ``least`` of what is connected, component its
    least class.
    """
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    named = named.select("id", "least", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).select(apart("component").alias("lk"), "component_id")
    return named.withColumn("ck", apart("component")).join(least, F.col("ck") == F.col("lk")).select("id", "n_links", "component_id", "component")


def least_labels(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric link matrix, the smallest index reachable from each row."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
