"""Fusion of two rankings (query_id, doc_id, score, rank) into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FAR = 1 << 40


def _both(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("query_id", "doc_id", F.col("score").alias("s1"), F.col("rank").alias("r1"))
    b = second.select("query_id", "doc_id", F.col("score").alias("s2"), F.col("rank").alias("r2"))
    return a.join(b, ["query_id", "doc_id"], "full")


def _ranked(df: DataFrame) -> DataFrame:
    """Ties go by the first ranking, then by the second for what only that has."""
    place = F.coalesce(F.col("r1").cast("long"), F.lit(_FAR) + F.col("r2"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), place)
    return df.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "rank")


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    both = _both(first, second)
    part = lambda r: F.coalesce(F.lit(1.0) / (F.col(r) + k), F.lit(0.0))
    return _ranked(both.withColumn("score", part("r1") + part("r2")))


def minmax(c: str) -> Column:
    """Scaled to 0..1 among a query's values; all equal gives 0, and a missing value counts as the least."""
    w = Window.partitionBy("query_id")
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.coalesce(F.when(high == low, F.lit(0.0)).otherwise((F.coalesce(F.col(c), low) - low) / (high - low)), F.lit(0.0))


def weighted_minmax_fusion(first: DataFrame, second: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha times the first, 1 - alpha times the second, both scaled for each query."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in 0..1")
    both = _both(first, second).withColumn("n1", minmax("s1")).withColumn("n2", minmax("s2"))
    return _ranked(both.withColumn("score", F.lit(alpha) * F.col("n1") + F.lit(1 - alpha) * F.col("n2")))
