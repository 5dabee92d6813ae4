"""Chart tables read several times, merged cell by cell: medians of numbers, most frequent texts, and how far readings agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import readings_aligned, readings_merged
from ..functions.text import numeric

LEAST_CONFIDENCE = 0.67


def self_ensemble(samples: DataFrame) -> DataFrame:
    """samples (figure_id, sample, linearized_table; two or more a figure) -> figure_id, linearized_table, parse_status, confidence, uncertainty.

    Readings of the most frequent shape (first seen at ties) are merged. A cell whose readings are all numbers is their median, else the most
    frequent text, first seen at ties. Uncertainty is the share of number cells whose readings differ.
    A figure's readings meet in one row, by a single shuffle, so its tables must fit a worker together.
    """
    each = samples.groupBy("figure_id").agg(F.sort_array(F.collect_list(F.struct("sample", "linearized_table"))).alias("readings"))
    aligned = each.select("figure_id", readings_aligned(F.col("readings.linearized_table")).alias("a")).select("figure_id", "a.*").withColumn("x", F.transform("values", numeric))
    out = aligned.select("figure_id", "rows", readings_merged("rows", "cols", "n", "values", "x").alias("m")).select("figure_id", "rows", "m.*")
    doubt = F.when(F.col("rows") == 0, 1.0).when(F.col("numbers") > 0, F.col("apart") / F.col("numbers")).otherwise(0.0)
    return out.select("figure_id", "linearized_table", doubt.alias("uncertainty")).withColumn("confidence", F.greatest(F.lit(0.0), 1 - F.col("uncertainty"))).withColumn(
        "parse_status", F.when(F.col("confidence") >= LEAST_CONFIDENCE, "ok").otherwise("suspect")
    )


def checked_repeats(repeats: int) -> int:
    if repeats < 2:
        raise ValueError("an ensemble takes two readings at least")
    return repeats


def first_seen_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an order column."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
