"""Registered queries over vectors whose score matrix is cut into blocks, each block where its number was hashed to, against their SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lumenfold.operators import mining, recall
from lumenfold.plans import registry


@pytest.fixture
def blocks_apart(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK_ROWS", 100)
    monkeypatch.setattr(recall, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(mining, "BLOCK_POSITIVES", 30)
    monkeypatch.setattr(mining, "BLOCK_POOL", 150)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def rounded(rows):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", ["cosine_topk_per_type", "hit_responses", "rrf_fusion", "rrf_weighted_library", "score_calibration", "score_components", "citation_prf", "per_type_recall", "ranking_metrics", "evidence_prf", "macro_summary", "micro_metrics", "hard_negatives"])
def test_blocks_of_rows_meet_blocks_of_queries(spark, data, blocks_apart, name):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = c.execute(registry.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert rounded(registry.QUERIES[name](spark, data).select(*columns).collect()) == rounded(want.fetchall())
