"""Graph operators over nodes (node_id, paper_id, node_type, ...) and edges (src, dst, relation, confidence), for many queries at once.

Seeds are rows of key columns (a query id, or more) and node_id; every operator keeps the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def undirected(edges: DataFrame, least_confidence: float | None = None) -> DataFrame:
    """Both directions of every edge as (a, b), without repeats."""
    e = edges if least_confidence is None else edges.where(F.col("confidence") >= least_confidence)
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def neighbors(seeds: DataFrame, edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Nodes next to each seed, whatever the direction."""
    e = edges if relations is None else edges.where(F.col("relation").isin(relations))
    return seeds.join(undirected(e), F.col("node_id") == F.col("a")).select(*seeds.columns, F.col("b").alias("neighbor")).distinct()


def expand(seeds: DataFrame, edges: DataFrame, hops: int, least_confidence: float = 0.8) -> DataFrame:
    """Seeds and all nodes within `hops` edges of at least that confidence; papers are crossed. Each hop's new nodes are written, so none is computed twice."""
    keys, scratch = [c for c in seeds.columns if c != "node_id"], Scratch(edges.sparkSession, "expand")
    sym = undirected(edges, least_confidence)
    reached = frontier = scratch.write(seeds.distinct())
    for _ in range(hops):
        step = frontier.join(sym, F.col("node_id") == F.col("a")).select(*keys, F.col("b").alias("node_id")).distinct()
        frontier = scratch.write(step.join(reached, [*keys, "node_id"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def paper_subgraph(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes among `chosen` (keys, paper_id, node_id) that lie in its paper, and edges with both ends among them."""
    keys = [c for c in chosen.columns if c != "node_id"]
    own = chosen.join(nodes.select("node_id", F.col("paper_id").alias("__p")), "node_id").where(F.col("__p") == F.col("paper_id")).drop("__p")
    a = own.withColumnRenamed("node_id", "src")
    b = own.withColumnRenamed("node_id", "dst")
    return own, edges.join(a, "src").join(b, [*keys, "dst"]).select(*keys, "src", "dst", "relation", "confidence")


@dataclass(frozen=True)
class Policy:
    """Which requirements count."""

    figure_needs_caption: bool = True
    table_needs_caption: bool = True
    chart_needs_source: bool = True
    sentence_needs_target: bool = True


def requirements(nodes: DataFrame, edges: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(node_id, needed): a figure or table needs its captions, chart data what it derives from, a sentence what it refers to, as far as the policy says."""
    ruled = [
        ("Figure", "caption_of", "dst", "src", policy.figure_needs_caption),
        ("Table", "caption_of", "dst", "src", policy.table_needs_caption),
        ("ChartData", "derived_from", "src", "dst", policy.chart_needs_source),
        ("Sentence", "refers_to", "src", "dst", policy.sentence_needs_target),
    ]
    kinds = nodes.select(F.col("node_id").alias("__id"), "node_type")
    # an edge gives what its relation's rules say of the end that needs; the types of that end decide
    by_end = {}
    for kind, relation, own, other, on in ruled:
        if on:
            by_end.setdefault((relation, own, other), []).append(kind)
    out = None
    for (relation, own, other), names in by_end.items():
        found = edges.where(F.col("relation") == relation).select(F.col(own).alias("node_id"), F.col(other).alias("needed"))
        found = found.join(kinds.where(F.col("node_type").isin(names)), F.col("node_id") == F.col("__id"), "left_semi")
        out = found if out is None else out.unionByName(found)
    return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("needed")).limit(0) if out is None else out.distinct()


def closure(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Least set that holds the seeds and whatever its members require, whatever the length of the chains.

    Steps go on, each written, until nothing new comes. A seed outside the graph is an error.
    """
    keys, scratch = [c for c in seeds.columns if c != "node_id"], Scratch(nodes.sparkSession, "closure")
    need = scratch.write(requirements(nodes, edges, policy)).withColumnRenamed("node_id", "__n")
    known = nodes.select(F.col("node_id").alias("__k"))
    checked = seeds.distinct().join(known, F.col("node_id") == F.col("__k"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown node "), F.coalesce("node_id", F.lit("null"))))
    reached = frontier = scratch.write(checked.where(F.when(F.col("__k").isNull(), unknown).otherwise(F.lit(True))).drop("__k"))
    while True:
        step = frontier.join(need, F.col("node_id") == F.col("__n")).select(*keys, F.col("needed").alias("node_id")).distinct()
        frontier = scratch.write(step.join(reached, [*keys, "node_id"], "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def closure_validity(selected: DataFrame, nodes: DataFrame, edges: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """By key: 1.0 if the selected nodes require nothing outside themselves."""
    keys = [c for c in selected.columns if c != "node_id"]
    extra = closure(selected, nodes, edges, policy).join(selected, [*keys, "node_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("__extra"))
    return selected.select(*keys).distinct().join(extra, keys, "left").select(*keys, F.when(F.col("__extra") > 0, 0.0).otherwise(1.0).alias("closure_validity"))


def dependency_completeness(selected: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By key: of the selected nodes that require something, the share whose whole requirement is selected; null without any."""
    keys = [c for c in selected.columns if c != "node_id"]
    whole = closure(selected.distinct().withColumn("origin", F.col("node_id")), nodes, edges).where("origin <> node_id")
    own = selected.distinct().withColumn("__in", F.lit(True))
    full = whole.join(own, [*keys, "node_id"], "left").groupBy(*keys, "origin").agg(F.every(F.coalesce("__in", F.lit(False))).alias("ok"))
    share = full.groupBy(*keys).agg(F.avg(F.col("ok").cast("double")).alias("dependency_completeness"))
    return selected.select(*keys).distinct().join(share, keys, "left")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end outside the graph, repeated ones as often as they are there."""
    ids = nodes.select(F.col("node_id").alias("__n"))
    begins = lambda how: edges.join(ids, F.col("src") == F.col("__n"), how)
    return begins("left_anti").unionByName(begins("left_semi").join(ids, F.col("dst") == F.col("__n"), "left_anti"))


def merged_nodes(parts: list[DataFrame]) -> DataFrame:
    """Union of node tables: the same id with the same content counts once, with other content is an error."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    same = both.dropDuplicates()
    conflict = F.raise_error(F.concat(F.lit("node with two contents: "), F.first("node_id")))
    cols = [c for c in same.columns if c != "node_id"]
    checked = same.groupBy("node_id").agg(F.when(F.count("*") > 1, conflict).otherwise(F.lit(True)).alias("__ok"), *[F.first(c).alias(c) for c in cols])
    return checked.where("__ok").select(*same.columns)


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """Rows that break an invariant, with the reasons: ids, confidence in [0, 1], figures' image, tables' text or image, boxes."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reasons = {
        "node_id": blank("node_id"),
        "paper_id": blank("paper_id"),
        "node_type": ~F.col("node_type").isin("Paper", "Section", "Paragraph", "Sentence", "Figure", "Table", "Caption", "ChartData"),
        "confidence": ~F.coalesce(F.col("confidence"), F.lit(1.0)).between(0, 1),
        "figure without image": (F.col("node_type") == "Figure") & blank("image_path"),
        "table without text or image": (F.col("node_type") == "Table") & blank("text") & blank("image_path"),
    }
    if "bbox" in nodes.columns:
        reasons["bbox"] = F.coalesce((F.col("bbox.x1") < F.col("bbox.x0")) | (F.col("bbox.y1") < F.col("bbox.y0")), F.lit(False))
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in reasons.items()]))
    return nodes.withColumn("reasons", found).where(F.size("reasons") > 0)


def invalid_edges(edges: DataFrame) -> DataFrame:
    """Self edges other than next_sentence, and confidence outside [0, 1]."""
    return edges.where(((F.col("src") == F.col("dst")) & (F.col("relation") != "next_sentence")) | ~F.col("confidence").between(0, 1))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))
