"""Stand-ins and adapters for models: a deterministic embedder, truncation to a dimension, batched calls of a caller's model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import l2_normalized


def mock_vector(text: str, dimension: int) -> list[float]:
    """A unit vector of normal numbers seeded by the text's digest."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).standard_normal(dimension)
    return (v / max(np.linalg.norm(v), 1e-12)).tolist()


def mock_embedding(text: Column, dimension: int = 64) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: mock_vector(x or "", dimension))

    return F.pandas_udf(run, "array<double>")(text)


def truncated(vector: Column, dimension: int) -> Column:
    """The first `dimension` numbers, as a unit vector. vector must be a column of its own."""
    return l2_normalized(F.slice(vector, 1, dimension))


def with_model(df: DataFrame, column: str, model: Callable[[list], list], kind: str, name: str, batch: int = 64) -> DataFrame:
    """df with `name`: what the model gives for values of a column, `batch` at a time; the model is made known to workers by pickling."""

    def run(s: pd.Series) -> pd.Series:
        values, out = s.tolist(), []
        for a in range(0, len(values), batch):
            part = values[a : a + batch]
            got = list(model(part))
            if len(got) != len(part):
                raise ValueError("a model must give one result a value")
            out += got
        return pd.Series(out, dtype="object" if "array" in kind or kind == "string" else None)

    return df.withColumn(name, F.pandas_udf(run, kind)(F.col(column)))
