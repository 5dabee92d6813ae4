"""Evidence selection for many queries at once: hits (query_id, node_id, paper_id, score, pos) -> trees and forests.

A tree is a row (query_id, paper_id, node_ids, relevance, cost, ...); a forest a query's trees. Only ec_bfr keeps the budget.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import node_cost
from ..sources.scratch import Scratch
from . import trees as kernels
from .graph import closure, expand, paper_subgraph, undirected
from .recall import searchable

LAMBDAS = (0.5, 1.0, 2.0)
BUDGET, IMAGE_UNIT, HOPS, CONFIDENCE, TOP_K = 4096, 512, 2, 0.8, 10
METHODS = ("top_k", "one_hop", "ppr", "pcst", "pcst_closure", "ec_bfr")
_CANDIDATE = "query_id {q}, paper_id string, ord int, scale double, node_ids array<string>"


def costed(nodes: DataFrame, image_unit: int = IMAGE_UNIT) -> DataFrame:
    n = searchable(nodes)
    return n.withColumn("cost", node_cost(F.col("node_type"), F.col("searchable_text"), F.col("image_path"), image_unit))


def union_cost(selected: DataFrame, nodes: DataFrame, image_unit: int = IMAGE_UNIT) -> DataFrame:
    """selected (query_id, node_id) -> query_id, n_nodes, total_cost: each node of a query counts once."""
    priced = selected.select("query_id", "node_id").distinct().join(costed(nodes, image_unit).select("node_id", "cost"), "node_id")
    return priced.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.sum("cost").cast("long").alias("total_cost"))


def entities_of(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """selected (query_id, node_id) -> query_id, entities: the distinct ones of its nodes (entities, an array), sorted."""
    each = selected.join(nodes.select("node_id", F.explode("entities").alias("e")), "node_id").select("query_id", "e").distinct()
    return each.groupBy("query_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))


def _fresh(df: DataFrame) -> DataFrame:
    """df under new column identities, so that it can be co-grouped with what it derives from."""
    return df.select([F.col(c).alias(c) for c in df.columns])


def ppr_ranked(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits with personalised PageRank over the graph they induce as score, and pos renewed."""
    a = hits.select(F.col("query_id"), F.col("node_id").alias("a"))
    b = hits.select(F.col("query_id").alias("__q"), F.col("node_id").alias("__b"))
    pairs = undirected(edges).join(a, "a").join(b, (F.col("query_id") == F.col("__q")) & (F.col("b") == F.col("__b"))).select("query_id", "a", "b").where("a <> b")

    def rank(h: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("pos", kind="stable")
        at = {n: i for i, n in enumerate(h.node_id)}
        h["score"] = kernels.page_rank(h.score.to_numpy(float), e.a.map(at).to_numpy(int), e.b.map(at).to_numpy(int)).round(9)
        h = h.sort_values("score", ascending=False, kind="stable")
        h["pos"] = range(1, len(h) + 1)
        return h

    return hits.groupBy("query_id").cogroup(_fresh(pairs).groupBy("query_id")).applyInPandas(rank, hits.schema)


def trees_by_paper(chosen: DataFrame, hits: DataFrame, nodes: DataFrame, image_unit: int = IMAGE_UNIT) -> DataFrame:
    """One tree for each paper of chosen (query_id, node_id): nodes, summed score (nothing for a node that is no hit) and cost."""
    info = costed(nodes, image_unit).select("node_id", "paper_id", "cost")
    scores = hits.select("query_id", "node_id", "score")
    rows = chosen.join(info, "node_id").join(scores, ["query_id", "node_id"], "left")
    return rows.groupBy("query_id", "paper_id").agg(
        F.array_sort(F.collect_list("node_id")).alias("node_ids"), F.sum(F.coalesce("score", F.lit(0.0))).alias("relevance"), F.sum("cost").cast("long").alias("cost")
    )


def ranked_selection(hits: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = TOP_K, hops: int = 0, image_unit: int = IMAGE_UNIT) -> DataFrame:
    """The first top_k hits that the graph has (counted before that check), expanded by hops, as one tree a paper."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    first = hits.where(F.col("pos") <= top_k).join(nodes.select("node_id"), "node_id", "left_semi").select("query_id", "node_id")
    return trees_by_paper(expand(first, edges, hops, CONFIDENCE) if hops else first, hits, nodes, image_unit)


def seeds_by_paper(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, paper_id, node_id, prize, paper_ord): hits of the graph, papers in the order of their first hit."""
    own = hits.join(nodes.select("node_id"), "node_id", "left_semi")
    order = own.groupBy("query_id", "paper_id").agg(F.min("pos").alias("paper_ord"))
    return own.join(order, ["query_id", "paper_id"]).select("query_id", "paper_id", "node_id", F.greatest(F.lit(0.0), "score").alias("prize"), "paper_ord")


def skeletons(hits: DataFrame, nodes: DataFrame, edges: DataFrame, scales=LAMBDAS, solver: str = "gw", hops: int = HOPS) -> DataFrame:
    """A prize-collecting tree for each (query, paper, scale) over the paper's part of the hits' neighbourhood."""
    seeds = seeds_by_paper(hits, nodes)
    # hits elsewhere may lie in the neighbourhood, and then bring their prize
    around = expand(seeds.select("query_id", "paper_id", "node_id"), edges, hops, CONFIDENCE)
    own, induced = paper_subgraph(nodes, edges, around)
    prizes = hits.select("query_id", "node_id", F.greatest(F.lit(0.0), "score").alias("prize"))
    order = seeds.select("query_id", "paper_id", "paper_ord").distinct()
    with_prize = own.join(prizes, ["query_id", "node_id"], "left").join(order, ["query_id", "paper_id"]).select("query_id", "paper_id", "paper_ord", "node_id", F.coalesce("prize", F.lit(0.0)).alias("prize"))
    key_type = dict(hits.dtypes)["query_id"]

    def solve(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if v.empty:
            return pd.DataFrame(columns=["query_id", "paper_id", "ord", "scale", "node_ids"])
        prize, rows = dict(zip(v.node_id, v.prize, strict=True)), []
        triples = list(zip(e.src, e.dst, e.relation, strict=True))
        for k, scale in enumerate(scales):
            kept = kernels.positive_prizes(prize) if solver == "fallback" else kernels.prize_tree(prize, prize, kernels.cheapest_pairs(triples, scale))
            rows.append((v.query_id.iloc[0], v.paper_id.iloc[0], int(v.paper_ord.iloc[0]) * len(scales) + k, scale, sorted(kept)))
        return pd.DataFrame(rows, columns=["query_id", "paper_id", "ord", "scale", "node_ids"])

    keys = ["query_id", "paper_id"]
    return with_prize.groupBy(*keys).cogroup(_fresh(induced).groupBy(*keys)).applyInPandas(solve, _CANDIDATE.format(q=key_type))


def covered_slots(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows (query_id, ord, node_id, searchable_text) -> (query_id, ord, slots): `answer` for any text, a slot whose value some node's text holds.

    A value is looked for within single nodes; numbers as their decimal form.
    """
    fields = [c for c in ("entity_type", "metric", "operator", "value", "unit") if c in queries.columns]
    wanted = [F.struct(F.lit(c).alias("slot"), F.lower(F.col(c).cast("string")).alias("text")) for c in fields]
    if "conditions" in queries.columns:
        listed = F.transform(F.coalesce("conditions", F.array().cast("array<string>")), lambda x: F.struct(F.lit("conditions").alias("slot"), F.lower(x).alias("text")))
    else:
        listed = F.array().cast("array<struct<slot:string,text:string>>")
    all_wanted = F.filter(F.concat(F.array(*wanted) if wanted else F.array().cast("array<struct<slot:string,text:string>>"), listed), lambda x: x["text"].isNotNull())
    q = queries.select("query_id", all_wanted.alias("wanted"))
    here = rows.join(q, "query_id").withColumn("low", F.lower("searchable_text"))
    found = F.transform(F.filter("wanted", lambda x: F.col("low").contains(x["text"])), lambda x: x["slot"])
    own = F.concat(F.when(F.trim("low") != "", F.array(F.lit("answer"))).otherwise(F.array().cast("array<string>")), found)
    return here.groupBy("query_id", "ord").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("slots"))


def required_slots(queries: DataFrame) -> DataFrame:
    """query_id and the number of slots it asks for: the answer, what is given, and conditions if there are any."""
    n = F.lit(1)
    for c in ("entity_type", "metric", "operator", "value", "unit"):
        if c in queries.columns:
            n = n + F.col(c).isNotNull().cast("int")
    if "conditions" in queries.columns:
        n = n + (F.size(F.coalesce("conditions", F.array().cast("array<string>"))) > 0).cast("int")
    return queries.select("query_id", n.alias("required"))


def candidates(hits: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, close: bool, max_cost: int | None = None, scales=LAMBDAS, image_unit: int = IMAGE_UNIT, solver: str = "gw", hops: int = HOPS) -> DataFrame:
    """Candidate trees in order (`ord`), each node set of a query once; relevance sums prizes, cost all nodes."""
    # written once: closure, deduplication and costing all start from it
    scratch = Scratch(nodes.sparkSession, "candidates")
    raw = scratch.write(skeletons(hits, nodes, edges, scales, solver, hops).where(F.size("node_ids") > 0))
    flat = raw.select("query_id", "paper_id", "ord", "scale", F.explode("node_ids").alias("node_id"))
    if close:
        flat = closure(flat, nodes, edges)
    sets = flat.groupBy("query_id", "paper_id", "ord", "scale").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    # the first of equal sets stays, before any is judged by its cost
    first = scratch.write(sets.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "node_ids").orderBy("ord"))).where("__n = 1").drop("__n"))
    entities = F.col("entities") if "entities" in nodes.columns else F.array().cast("array<string>")
    info = costed(nodes, image_unit).select("node_id", "cost", "searchable_text", entities.alias("entities"))
    prizes = hits.select("query_id", "node_id", F.greatest(F.lit(0.0), "score").alias("prize"))
    rows = first.select("query_id", "ord", F.explode("node_ids").alias("node_id")).join(info, "node_id").join(prizes, ["query_id", "node_id"], "left")
    measured = rows.groupBy("query_id", "ord").agg(
        F.sum(F.coalesce("prize", F.lit(0.0))).alias("relevance"), F.sum("cost").cast("long").alias("cost"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities")
    )
    out = first.join(measured, ["query_id", "ord"]).join(covered_slots(rows, queries), ["query_id", "ord"])
    return out if max_cost is None else out.where(F.col("cost") <= max_cost)


def best_candidate(found: DataFrame) -> DataFrame:
    """The candidate of greatest relevance, then least cost, then first; compared at nine digits."""
    w = Window.partitionBy("query_id").orderBy(F.round("relevance", 9).desc(), "cost", "ord")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def greedy(found: DataFrame, nodes: DataFrame, queries: DataFrame, budget: int = BUDGET, image_unit: int = IMAGE_UNIT) -> DataFrame:
    """The budgeted forest of each query, in the order of picking (`pick`), with its union cost `total_cost`."""
    costs = costed(nodes, image_unit).select("node_id", F.col("cost").alias("c"))
    priced = found.select("query_id", "ord", F.explode("node_ids").alias("node_id")).join(costs, "node_id").groupBy("query_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "c"))).alias("costs"))
    rows = found.join(priced, ["query_id", "ord"]).join(required_slots(queries), "query_id")
    schema = rows.drop("costs", "required").schema.add("pick", T.IntegerType()).add("total_cost", T.LongType())

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord", kind="stable").reset_index(drop=True)
        cost: dict[str, int] = {}
        for m in g.costs:
            cost.update(m if isinstance(m, dict) else dict(m))
        items = [{"nodes": list(r.node_ids), "relevance": r.relevance, "slots": list(r.slots), "entities": list(r.entities)} for r in g.itertuples()]
        order = kernels.greedy_forest(items, budget, cost, int(g.required.iloc[0]))
        out = g.iloc[order].drop(columns=["costs", "required"]).copy()
        out["pick"] = range(1, len(order) + 1)
        out["total_cost"] = sum(cost[n] for n in {n for i in order for n in items[i]["nodes"]})
        return out

    return rows.groupBy("query_id").applyInPandas(pick, schema)


def retrieve(method: str, hits: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, top_k: int = TOP_K, budget: int = BUDGET, image_unit: int = IMAGE_UNIT, scales=LAMBDAS) -> DataFrame:
    """Trees (query_id, paper_id, node_ids, relevance, cost) by one of METHODS, whatever the case of its name."""
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method in ("top_k", "one_hop", "ppr"):
        ranked = ppr_ranked(hits, edges) if method == "ppr" else hits
        return ranked_selection(ranked, nodes, edges, top_k, 1 if method == "one_hop" else 0, image_unit)
    found = candidates(hits, nodes, edges, queries, method != "pcst", budget if method == "ec_bfr" else None, scales, image_unit)
    chosen = greedy(found, nodes, queries, budget, image_unit) if method == "ec_bfr" else best_candidate(found)
    return chosen.select("query_id", "paper_id", "node_ids", "relevance", "cost")
