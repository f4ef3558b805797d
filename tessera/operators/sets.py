"""Set operations on tables of document ids; a union also takes tables with more columns. Hints may say how to join; they never change the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HINTS = {"adaptive": None, "broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash"}


def hinted(right: DataFrame, strategy: str) -> DataFrame:
    """adaptive: the optimizer chooses by size. broadcast is for sides whose size the caller has checked."""
    hint = HINTS[strategy]
    return right.hint(hint) if hint else right


def intersect(left: DataFrame, right: DataFrame, strategy: str = "adaptive") -> DataFrame:
    return left.join(hinted(right, strategy), "doc_id", "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Spark 4.1 takes a union for partitioned by doc_id where both sides are, and under joins and other unions adaptive
    execution then fails on unequal numbers of partitions. A computed doc_id has no such partitioning."""
    left, right = (side.withColumn("doc_id", F.col("doc_id") + 0) for side in (left, right))
    return left.union(right).distinct()


def difference(left: DataFrame, right: DataFrame, strategy: str = "adaptive") -> DataFrame:
    return left.join(hinted(right, strategy), "doc_id", "left_anti")
