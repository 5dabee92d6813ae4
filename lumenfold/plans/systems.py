"""The retrieval chain over many queries, and the named systems that are set-ups of it.

recall -> graph scores -> reranking -> fusion -> (PageRank) -> selection -> metrics. Models are functions of DataFrames or columns, given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, l2_normalized
from ..operators import evaluate, fusion, graph, recall, select
from ..operators.recall import searchable
from ..sources.scratch import Scratch


@dataclass(frozen=True)
class System:
    """candidates: bm25 or dense; method: one of select.METHODS; whether a reranker and graph scores take part."""

    candidates: str
    method: str
    rerank: bool = False
    graph_scores: bool = False


#: The compared systems.
SYSTEMS = {
    "bm25": System("bm25", "top_k"),
    "dense": System("dense", "top_k"),
    "dense_reranker": System("dense", "top_k", rerank=True),
    "one_hop": System("dense", "one_hop"),
    "ppr": System("dense", "ppr"),
    "pcst": System("dense", "pcst"),
    "pcst_closure": System("dense", "pcst_closure"),
    "ec_bfr": System("dense", "ec_bfr"),
    "ec_bfr_reranker": System("dense", "ec_bfr", rerank=True),
    "full": System("dense", "ec_bfr", rerank=True, graph_scores=True),
}


@dataclass(frozen=True)
class Setting:
    """per_type_k of recall; top_k, budget and image_unit of selection."""

    per_type_k: int = 25
    top_k: int = select.TOP_K
    budget: int = select.BUDGET
    image_unit: int = select.IMAGE_UNIT
    scales: tuple[float, ...] = select.LAMBDAS


def graph_scored(hits: DataFrame, projected: DataFrame, vectors: DataFrame) -> DataFrame:
    """hits with `hgt`: cosine of the query's projected vector (query_id, projected) and the node's graph vector (node_id, graph_vector), 0 where there is none."""
    q = projected.select("query_id", l2_normalized(F.col("projected")).alias("__q"))
    v = vectors.select("node_id", l2_normalized(F.col("graph_vector")).alias("__v"))
    return hits.join(q, "query_id", "left").join(v, "node_id", "left").withColumn("hgt", F.coalesce(F.round(dot(F.col("__q"), F.col("__v")), recall.DIGITS), F.lit(0.0))).drop("__q", "__v")


def rerank_documents(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits with `document`: the image, if it is a figure or table with one, and the text."""
    n = searchable(nodes).select("node_id", F.col("node_type").alias("__t"), "image_path", "searchable_text")
    pictured = F.col("__t").isin("Figure", "Table") & (F.coalesce("image_path", F.lit("")) != "")
    return hits.join(n, "node_id").withColumn("document", F.struct(F.when(pictured, F.col("image_path")).alias("image"), F.col("searchable_text").alias("text"))).drop("__t", "image_path", "searchable_text")


def no_reranker(query: Column, document: Column) -> Column:
    return F.lit(0.0)


def ranked_hits(system: System, queries: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None, setting: Setting = Setting(), reranker: Callable[[Column, Column], Column] | None = None, graph_scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fused hits (query_id, node_id, paper_id, node_type, score, pos) of one system."""
    if system.candidates == "bm25":
        if system.graph_scores:
            raise ValueError("graph scores need dense candidates")
        hits, scorers = recall.bm25(queries, nodes, setting.per_type_k).withColumnRenamed("score", "bm25"), ["bm25"]
    else:
        if vectors is None:
            raise ValueError("dense candidates need vectors")
        hits, scorers = recall.cosine(queries, vectors, setting.per_type_k).withColumnRenamed("score", "embedding"), ["embedding"]
    if system.graph_scores:
        if graph_scorer is None:
            raise ValueError("this system needs a graph scorer")
        hits, scorers = graph_scorer(hits), [*scorers, "hgt"]
    if system.rerank:
        score = reranker or no_reranker
        asked = queries.select("query_id", "query")
        hits = rerank_documents(hits, nodes).join(asked, "query_id").withColumn("reranker", score(F.col("query"), F.col("document"))).drop("document", "query")
        scorers = [*scorers, "reranker"]
    return fusion.fused(hits, scorers).select("query_id", "node_id", "paper_id", "node_type", "score", "pos")


def run(system: System, queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, setting: Setting = Setting(), **models) -> tuple[DataFrame, DataFrame]:
    """(hits, trees) of one system for all queries. Hits are written before selection, which reads them many times."""
    hits = Scratch(nodes.sparkSession, "hits").write(ranked_hits(system, queries, nodes, vectors, setting, **models))
    trees = select.retrieve(system.method, hits, nodes, edges, queries, setting.top_k, setting.budget, setting.image_unit, setting.scales)
    return (select.ppr_ranked(hits, edges) if system.method == "ppr" else hits), trees


def metrics(hits: DataFrame, trees: DataFrame, gold: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = select.BUDGET, cutoffs=(1, 3, 5, 10)) -> DataFrame:
    """One row a query of gold: ranking, evidence, closure, dependency and budget metrics. The cost of a forest is its trees' sum, the union's for one of ec_bfr (give it as `total_cost`)."""
    picked = trees.select("query_id", F.explode("node_ids").alias("node_id")).distinct()
    cost = F.max("total_cost") if "total_cost" in trees.columns else F.sum("cost")
    forest = trees.groupBy("query_id").agg(cost.cast("double").alias("evidence_cost"))
    parts = [
        evaluate.ranking_metrics(hits, gold, cutoffs),
        evaluate.evidence_metrics(picked, gold),
        graph.closure_validity(picked, nodes, edges),
        graph.dependency_completeness(picked, nodes, edges),
        forest,
        picked.groupBy("query_id").agg(F.count("*").cast("double").alias("selected_nodes")),
    ]
    out = reduce(lambda a, b: a.join(b, "query_id", "left"), parts)
    return out.withColumns({
        "closure_validity": F.coalesce("closure_validity", F.lit(1.0)),  # an empty selection is closed
        "evidence_cost": F.coalesce("evidence_cost", F.lit(0.0)),
        "selected_nodes": F.coalesce("selected_nodes", F.lit(0.0)),
        "budget_violation": (F.coalesce("evidence_cost", F.lit(0.0)) > budget).cast("double"),
    })


def benchmark(systems: dict[str, System], queries: DataFrame, gold: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, setting: Setting = Setting(), **models) -> DataFrame:
    """(run, metric, value): macro means of every system, all over the same queries.

    Systems that recall and rank alike share written hits, and all systems' metrics are computed at once, keyed by run and query.
    """
    scratch, recalled, hits, trees = Scratch(nodes.sparkSession, "benchmark"), {}, [], []
    for name, system in systems.items():
        tagged = lambda df, *c: df.select(F.struct(F.lit(name).alias("run"), F.col("query_id").alias("id")).alias("query_id"), *c)  # noqa: B023, E731
        how = (system.candidates, system.rerank, system.graph_scores)
        if how not in recalled:
            recalled[how] = scratch.write(ranked_hits(system, queries, nodes, vectors, setting, **models))
        found = recalled[how]
        chosen = select.retrieve(system.method, found, nodes, edges, queries, setting.top_k, setting.budget, setting.image_unit, setting.scales)
        hits.append(tagged(select.ppr_ranked(found, edges) if system.method == "ppr" else found, "node_id", "pos"))
        trees.append(tagged(chosen, "node_ids", F.col("cost").cast("double").alias("cost")))
    every = gold.select(F.explode(F.array(*[F.lit(x) for x in systems])).alias("run"), F.col("query_id").alias("id"), "node_id").select(F.struct("run", "id").alias("query_id"), "node_id")
    both = (scratch.write(reduce(DataFrame.unionByName, x)) for x in (hits, trees))
    rows = metrics(*both, every, nodes, edges, setting.budget).withColumn("run", F.col("query_id.run"))
    return evaluate.macro_summary(rows, ["run"]).select("run", "metric", F.col("mean").alias("value"))


def batch_consistency(one: DataFrame, other: DataFrame, least: float = 0.999) -> DataFrame:
    """Queries (query_id, query_vector) whose two embeddings' cosine is under `least`."""
    a = one.select("query_id", l2_normalized(F.col("query_vector")).alias("a"))
    b = other.select("query_id", l2_normalized(F.col("query_vector")).alias("b"))
    return a.join(b, "query_id").withColumn("cosine", dot(F.col("a"), F.col("b"))).where(F.col("cosine") < least).select("query_id", "cosine")
