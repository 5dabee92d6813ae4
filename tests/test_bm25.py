"""BM25 queries whose score matrix is cut into many blocks, against their SQL on small tables."""

from collections import Counter

import pytest

from lumenfold.operators import recall
from lumenfold.plans import registry

WORDS = "heron reed marsh tide gull nest egg coast".split()


def rows(n_docs, sources):
    """Documents of three sentences; each sentence has words of its own, and its number."""
    def sentence(i):
        return "The " + " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 3 + i % 5)) + f" number {i} was seen."

    return [(d, " ".join(sentence(3 * d + s) for s in range(3)), sources[d % len(sources)]) for d in range(n_docs)]


@pytest.fixture
def blocks_apart(spark, monkeypatch):
    """Blocks of few nodes and queries, whose partitions stay as they were hashed."""
    monkeypatch.setattr(recall, "POSTED_NODES", 10)
    monkeypatch.setattr(recall, "POSTED_QUERIES", 3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def compared(spark, folder, name, documents):
    import duckdb

    spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    asked = [(i, f"{WORDS[i % 8]} {WORDS[(i + 3) % 8]} {WORDS[i % 8]} number {i}") for i in range(10)] + [(10, ""), (11, None), (None, "heron reed")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = Counter(c.execute(registry.ORACLES[name]).fetchall())
    return Counter(map(tuple, registry.QUERIES[name](spark, str(folder)).collect())), want


def test_blocks_of_nodes_meet_blocks_of_queries(spark, tmp_path, blocks_apart):
    got, want = compared(spark, tmp_path, "bm25_topk", rows(16, ["src1", "src2"]))
    assert got == want and len({r[0] for r in want}) == 10


def test_scopes_in_blocks(spark, tmp_path, blocks_apart):
    """Scopes of one paper, of two and of all, to which sentences without a paper belong too; a document and a query without an id."""
    documents = [*rows(32, [None, "src1", "src2", "src3", "src5"]), (None, rows(1, ["src1"])[0][1], "src1")]
    got, want = compared(spark, tmp_path, "bm25_scoped", documents)
    assert got == want and any(r[1] is None for r in want) and {r[2] for r in want if r[0] == 0} == {r[2] for r in want if r[0] == 4} == {None, "src1", "src2", "src3", "src5"}
