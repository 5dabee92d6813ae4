"""Command line: python -m lumenfold.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import build, charts, evaluate, graph, mapping, reports
from .plans import systems
from .sources import graphs


def _session() -> SparkSession:
    return SparkSession.builder.appName("lumenfold").getOrCreate()


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file, or of a folder of tables."""
    return graphs.read_graph(spark, path) if path.endswith(".json") else (spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def build_graph(spark, a) -> None:
    """Layout blocks to a graph; blocks without what they need are counted."""
    nodes, edges, warnings = build.blocks_to_graph(graphs.read_blocks(spark, a.blocks), a.base)
    graphs.write_graph(nodes, edges, a.out)
    warnings.groupBy("warning").count().show(truncate=False)


def inspect_graph(spark, a) -> None:
    nodes, edges = _tables(spark, a.graph)
    graph.type_counts(nodes).show()
    edges.groupBy("relation").count().show()


def list_figures(spark, a) -> None:
    build.listed_figures(_tables(spark, a.graph)[0]).write.json(a.out)


def merge_graphs(spark, a) -> None:
    parts = [_tables(spark, p) for p in a.graphs]
    edges = parts[0][1]
    for _, e in parts[1:]:
        edges = edges.unionByName(e)
    nodes = graph.merged_nodes([n for n, _ in parts])
    lost = graph.dangling_edges(nodes, edges).limit(1).count()
    if lost:
        raise ValueError("an edge leads out of the merged graph")
    graphs.write_graph(nodes, edges, a.out)


def enrich_charts(spark, a) -> None:
    """Chart tables of a manifest as nodes, then every figure's text view."""
    nodes, edges = _tables(spark, a.graph)
    made, links = build.attach_chart_data(nodes, graphs.read_lines(spark, a.manifest, "figure_id string, linearized_table string, confidence double").where("linearized_table IS NOT NULL"))
    both, all_edges = nodes.unionByName(made, allowMissingColumns=True), edges.unionByName(links, allowMissingColumns=True)
    views = build.figure_text_views(both, all_edges)
    graphs.write_graph(both.drop("text_view").join(views, "node_id", "left"), all_edges, a.out)


def run_benchmark(spark, a) -> None:
    """Macro metrics of the named systems over samples, as tables and a comparison."""
    settings = config.setting_of(config.load(a.config)) if a.config else systems.Setting()
    nodes, edges = _tables(spark, a.graph)
    samples = graphs.read_samples(spark, a.samples, nodes)
    gold = samples.select("query_id", F.explode("relevant_node_ids").alias("node_id"))
    vectors, queries = None, samples
    if a.vectors:
        vectors = graphs.read_vectors(spark, a.vectors, nodes).join(nodes.select("node_id", "paper_id", "node_type"), "node_id").withColumn("ord", F.col("node_id"))
        queries = samples.join(spark.read.parquet(a.query_vectors), "query_id")
    report = systems.benchmark({k: systems.SYSTEMS[k] for k in a.systems}, queries, gold, nodes, edges, vectors, settings)
    report.write.json(f"{a.out}/report")
    names = [r.metric for r in report.select("metric").distinct().orderBy("metric").collect()]
    graphs.write_comparison(evaluate.comparison(spark.read.json(f"{a.out}/report"), names), f"{a.out}/comparison")


def merge_charts(spark, a) -> None:
    """Several readings of each chart merged into one."""
    charts.checked_repeats(a.repeats)
    charts.self_ensemble(graphs.read_lines(spark, a.samples, "figure_id string, sample int, linearized_table string").where(F.col("sample") < a.repeats)).write.json(a.out)


def index(spark, a) -> None:
    """Vectors of a graph into a collection, and a report of what is indexed."""
    nodes, _ = _tables(spark, a.graph)
    vectors = graphs.read_vectors(spark, a.vectors, nodes)
    first = vectors.select(F.size("vector").alias("n")).first()
    dimension = first["n"] if first else 0
    graphs.upsert_nodes(vectors, nodes.withColumn("page", F.col("page") if "page" in nodes.columns else F.lit(None).cast("int")), a.out, dimension)
    reports.index_report(nodes, dimension).write.json(f"{a.out}/report")


def map_evidence(spark, a) -> None:
    """Evidence texts (JSON lines of evidence_id, paper_id, evidence) to nodes of a graph."""
    evidence = graphs.read_lines(spark, a.evidence, "evidence_id string, paper_id string, evidence string")
    mapping.map_evidence(evidence, _tables(spark, a.graph)[0], a.least).write.json(a.out)


def report_preparation(spark, a) -> None:
    """Counts of a prepared set: papers, nodes, edges, samples and what was dropped."""
    nodes, edges = _tables(spark, a.graph)
    samples = graphs.read_lines(spark, a.samples, "query_id string, dropped string")
    reports.preparation_report(nodes, edges, samples).write.json(a.out)


def validate_config(spark, a) -> None:
    config.check(config.load(a.config))


COMMANDS = {
    "build-graph": (build_graph, ["blocks", "out"], {"--base": None}),
    "inspect-graph": (inspect_graph, ["graph"], {}),
    "list-figures": (list_figures, ["graph", "out"], {}),
    "enrich-charts": (enrich_charts, ["graph", "manifest", "out"], {}),
    "merge-charts": (merge_charts, ["samples", "out"], {"--repeats": 3}),
    "index": (index, ["graph", "vectors", "out"], {}),
    "map-evidence": (map_evidence, ["graph", "evidence", "out"], {"--least": 0.85}),
    "report-preparation": (report_preparation, ["graph", "samples", "out"], {}),
    "validate-config": (validate_config, ["config"], {}),
    "benchmark": (run_benchmark, ["graph", "samples", "out"], {"--config": None, "--vectors": None, "--query-vectors": None}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    sub = p.add_subparsers(required=True)
    for name, (f, places, options) in COMMANDS.items():
        c = sub.add_parser(name, help=f.__doc__)
        for x in places:
            c.add_argument(x)
        for x, default in options.items():
            c.add_argument(x, default=default, type=type(default) if default is not None else str)
        if name == "benchmark":
            c.add_argument("--systems", nargs="+", default=["bm25"], choices=list(systems.SYSTEMS))
        c.set_defaults(run=f)
    c = sub.add_parser("merge-graphs", help=merge_graphs.__doc__)
    c.add_argument("graphs", nargs="+")
    c.add_argument("--out", required=True)
    c.set_defaults(run=merge_graphs)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(_session(), a)


if __name__ == "__main__":
    main()
