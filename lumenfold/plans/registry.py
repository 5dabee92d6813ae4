"""Name -> query, and name -> DuckDB SQL, for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from . import graph_queries, retrieval_queries

QUERIES: dict[str, Callable] = {**retrieval_queries.Q, **graph_queries.Q}
ORACLES: dict[str, str] = {**retrieval_queries.SQL, **graph_queries.SQL}
