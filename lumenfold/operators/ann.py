"""Approximate cosine search by inverted lists: every vector lies in the list of its nearest centre, a query looks through the nearest few.

Centres are fitted on a bounded sample (`sample` vectors, smallest hashes of their ids first); every vector is indexed. With as many
probes as lists the search is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, l2_normalized
from .recall import DIGITS, TYPES, best_per_type

SAMPLE, LISTS, PROBES = 20_000, 64, 16


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centres (lists x dimension) of unit length, by spherical k-means from evenly spaced sample vectors."""
    rows = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("node_id"), "node_id").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    x = _unit(np.array([r[0] for r in rows], np.float64))
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def _nearest(centres: np.ndarray, n: int):
    def run(column: pa.Array) -> pa.Array:
        x = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
        best = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * best.shape[1], pa.int32()), pa.array(best.ravel().astype(np.int32)))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with `list`, the number of the nearest centre; write it partitioned by list, and a search reads only what it probes."""
    return vectors.where("vector IS NOT NULL").withColumn("list", _nearest(centres, 1)("vector")[0])


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 25, probes: int = PROBES, types=TYPES) -> DataFrame:
    """queries (query_id, query_vector) against an assigned index -> the k best of each type, as exact cosine gives them, among the probed lists."""
    asked = queries.where("query_vector IS NOT NULL").select("query_id", l2_normalized(F.col("query_vector")).alias("asked"), F.explode(_nearest(centres, min(probes, len(centres)))("query_vector")).alias("list"))
    rows = index.where(F.col("node_type").isin(list(types))).withColumn("unit", l2_normalized(F.col("vector"))).drop("vector")
    scored = rows.join(asked, "list").withColumn("score", F.round(dot(F.col("unit"), F.col("asked")), DIGITS))
    return best_per_type(scored, k, F.col("ord"), F.col("node_id")).select("query_id", "node_id", "paper_id", "node_type", "score", "pos")
