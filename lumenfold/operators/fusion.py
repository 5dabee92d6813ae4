"""Fusing scorers: reciprocal ranks over recalled hits, reciprocal ranks over given rankings, calibrated weighted sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Score of a scorer that says nothing about a hit.
MISSING = -1e9
DIGITS = 12


def fused(hits: DataFrame, scorers: list[str], k: int = 60) -> DataFrame:
    """hits (query_id, node_id, pos, one nullable column a scorer) with score and pos renewed.

    Each scorer that speaks for any hit of the query ranks all of its hits, silent ones last, equal ones as they came; the sum of
    1 / (k + rank) orders them anew.
    """
    total, ranked = F.lit(0.0), hits
    for i, s in enumerate(scorers):
        order = Window.partitionBy("query_id").orderBy(F.coalesce(F.col(s), F.lit(MISSING)).desc(), "pos")
        speaks = F.max(F.col(s).isNotNull()).over(Window.partitionBy("query_id"))
        ranked = ranked.withColumn(f"__r{i}", F.when(speaks, 1.0 / (k + F.row_number().over(order))).otherwise(0.0))
        total = total + F.col(f"__r{i}")
    ranked = ranked.withColumn("score", F.round(total, DIGITS)).drop(*[f"__r{i}" for i in range(len(scorers))])
    return ranked.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos")))


def reciprocal_rank_fusion(rankings: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """rankings (query_id, scorer, node_id, rank from 1) -> query_id, node_id, score; an absent hit adds nothing."""
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("scorer") == name, F.lit(float(value))).otherwise(w)
    return rankings.groupBy("query_id", "node_id").agg(F.round(F.sum(w / (k + F.col("rank"))), DIGITS).alias("score"))


def calibration(scores: DataFrame) -> DataFrame:
    """scores (node_type, scorer, value) -> n, mean and sample deviation of each pair."""
    return scores.groupBy("node_type", "scorer").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def calibrated(scores: DataFrame, stats: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Adds z; a pair seen less than twice keeps its raw value."""
    z = (F.col("value") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(floor))
    return scores.join(stats, ["node_type", "scorer"], "left").withColumn("z", F.when(F.coalesce("n", F.lit(0)) < 2, F.col("value")).otherwise(z)).drop("n", "mean", "sd")


def weighted(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of z by weight over scorers of each (query_id, node_id); a scorer without a weight counts nothing."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("scorer") == name, F.lit(float(value))).otherwise(w)
    return scores.groupBy("query_id", "node_id").agg(F.sum(w * F.col("z")).alias("score"))
