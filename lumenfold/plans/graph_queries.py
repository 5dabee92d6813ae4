"""Registered queries on graphs, building, selection, mapping and mining, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import build, charts, graph, mapping, mining, reports, select
from ..sources.scratch import Scratch
from . import projections as P
from .oracle import GRAPH, SELECTED, SENTENCES, cte

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _seeds(spark, sf, k: int = 10):
    return P.graph_hits(spark, sf).where(F.col("pos") <= k).select("query_id", "node_id")


@query("inspect_graph", cte(GRAPH) + "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def inspect_graph(spark, sf):
    return graph.type_counts(P.graph(spark, sf)[0])


@query("node_cost", cte(GRAPH) + "SELECT node_id, cost FROM cost")
def node_cost(spark, sf):
    return select.costed(P.graph(spark, sf)[0]).select("node_id", "cost")


@query("list_figures", cte(GRAPH) + "SELECT node_id, paper_id, image_path FROM nodes WHERE node_type = 'Figure'")
def list_figures(spark, sf):
    return build.listed_figures(P.graph(spark, sf)[0]).select("node_id", "paper_id", "image_path")


@query("edge_integrity", cte(GRAPH) + "SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'ChartData') OR dst NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'ChartData')")
def edge_integrity(spark, sf):
    """Edges left dangling by a graph without its chart data."""
    nodes, edges = P.graph(spark, sf)
    return graph.dangling_edges(nodes.where("node_type <> 'ChartData'"), edges).select("src", "dst", "relation")


@query("merge_graphs", cte(GRAPH) + "SELECT node_type, count(*) AS n, count(DISTINCT paper_id) AS papers FROM nodes GROUP BY 1")
def merge_graphs(spark, sf):
    """Two overlapping halves of the graph, merged."""
    nodes, _ = P.graph(spark, sf)
    half = nodes.where(F.pmod(F.xxhash64("node_id"), F.lit(3)) < 2)
    other = nodes.where(F.pmod(F.xxhash64("node_id"), F.lit(3)) > 0)
    return graph.merged_nodes([half, other]).groupBy("node_type").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


@query("neighbors", cte(GRAPH) + "SELECT DISTINCT query_id, node_id, b AS neighbor FROM hits JOIN sym ON a = node_id WHERE pos <= 10")
def neighbors(spark, sf):
    return graph.neighbors(_seeds(spark, sf), P.graph(spark, sf)[1])


_EXPANDED = "ex AS (SELECT query_id, node_id, 0 AS h FROM hits WHERE pos <= 10 UNION SELECT ex.query_id, b, h + 1 FROM ex JOIN sym ON a = ex.node_id AND confidence >= 0.8 WHERE h < 2)"


@query("expand_2hop", cte(GRAPH, _EXPANDED) + "SELECT DISTINCT query_id, node_id FROM ex")
def expand_2hop(spark, sf):
    return graph.expand(_seeds(spark, sf), P.graph(spark, sf)[1], 2)


@query(
    "paper_subgraph",
    cte(GRAPH, _EXPANDED, "own AS (SELECT DISTINCT query_id, paper_id, node_id FROM ex JOIN nodes USING (node_id))")
    + "SELECT a.query_id, a.paper_id, src, dst, relation FROM edges JOIN own a ON a.node_id = src JOIN own b ON b.node_id = dst AND a.query_id = b.query_id AND a.paper_id = b.paper_id",
)
def paper_subgraph(spark, sf):
    nodes, edges = P.graph(spark, sf)
    hits = P.graph_hits(spark, sf).where("pos <= 10")
    papers = hits.select("query_id", F.col("paper_id").alias("p")).distinct()
    around = graph.expand(_seeds(spark, sf), edges, 2).join(papers, "query_id").select("query_id", F.col("p").alias("paper_id"), "node_id")
    return graph.paper_subgraph(nodes, edges, around)[1].select("query_id", "paper_id", "src", "dst", "relation")


@query("evidence_closure", cte(GRAPH, SELECTED) + "SELECT query_id, node_id FROM closed")
def evidence_closure(spark, sf):
    return graph.closure(_seeds(spark, sf), *P.graph(spark, sf))


@query(
    "closure_chain",
    cte(GRAPH, "more AS (SELECT 'l' || ok || ':' || ln AS node_id, 'l' || ok || ':' || prev AS needed FROM (SELECT ok, ln, lag(ln) OVER (PARTITION BY ok ORDER BY ln) AS prev FROM line) WHERE prev IS NOT NULL)",
        "wants AS (SELECT * FROM need UNION SELECT * FROM more)", "seed AS (SELECT query_id, node_id FROM hits WHERE pos <= 10)",
        "chain AS (SELECT query_id, node_id FROM seed UNION SELECT c.query_id, needed FROM chain c JOIN wants USING (node_id))")
    + "SELECT query_id, node_id FROM chain",
)
def closure_chain(spark, sf):
    """Lines also refer to the line before, so chains are as long as orders."""
    nodes, edges = P.graph(spark, sf)
    before = F.lag("ln").over(Window.partitionBy("ok").orderBy("ln"))
    lines = P.order_lines(spark, sf).withColumn("prev", before).where("prev IS NOT NULL")
    more = lines.select(F.concat(F.lit("l"), "ok", F.lit(":"), "ln").alias("src"), F.concat(F.lit("l"), "ok", F.lit(":"), "prev").alias("dst"), F.lit("refers_to").alias("relation"), F.lit(1.0).alias("confidence"))
    return graph.closure(_seeds(spark, sf), nodes, edges.unionByName(more))


@query("closure_policy", cte(GRAPH, "wants AS (SELECT need.* FROM need JOIN nodes USING (node_id) WHERE node_type = 'Sentence')", "seed AS (SELECT query_id, node_id FROM hits WHERE pos <= 10)", "part AS (SELECT query_id, node_id FROM seed UNION SELECT c.query_id, needed FROM part c JOIN wants USING (node_id))") + "SELECT query_id, node_id FROM part")
def closure_policy(spark, sf):
    """Only what sentences refer to is required."""
    return graph.closure(_seeds(spark, sf), *P.graph(spark, sf), graph.Policy(figure_needs_caption=False, table_needs_caption=False, chart_needs_source=False))


@query("relation_neighbors", cte(GRAPH) + "SELECT DISTINCT query_id, h.node_id, CASE WHEN src = h.node_id THEN dst ELSE src END AS neighbor FROM hits h JOIN edges ON relation IN ('refers_to', 'caption_of') AND (src = h.node_id OR dst = h.node_id) WHERE pos <= 10")
def relation_neighbors(spark, sf):
    return graph.neighbors(_seeds(spark, sf), P.graph(spark, sf)[1], ["refers_to", "caption_of"])


@query(
    "closure_validity",
    cte(GRAPH, SELECTED, "sel AS (SELECT query_id, 'seed' AS what, node_id FROM seed UNION ALL SELECT query_id, 'closed', node_id FROM closed)")
    + "SELECT s.query_id, s.what, CASE WHEN count(*) FILTER (needed IS NOT NULL AND m.node_id IS NULL) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS closure_validity FROM sel s LEFT JOIN need n USING (node_id) LEFT JOIN sel m ON m.query_id = s.query_id AND m.what = s.what AND m.node_id = needed GROUP BY 1, 2",
)
def closure_validity(spark, sf):
    nodes, edges = P.graph(spark, sf)
    return graph.closure_validity(_both_selections(spark, sf), nodes, edges)


def _both_selections(spark, sf):
    seeds = _seeds(spark, sf)
    closed = graph.closure(seeds, *P.graph(spark, sf))
    return seeds.withColumn("what", F.lit("seed")).unionByName(closed.withColumn("what", F.lit("closed")))


@query(
    "dependency_completeness",
    cte(GRAPH, "seed AS (SELECT query_id, node_id FROM hits WHERE pos <= 10)", "sel AS (SELECT query_id, node_id FROM seed UNION SELECT query_id, 'o' || substr(split_part(node_id, ':', 1), 2) FROM seed WHERE substr(split_part(node_id, ':', 1), 2)::BIGINT % 2 = 0)",
        "req AS (SELECT query_id, node_id AS origin, needed AS node_id FROM sel JOIN need USING (node_id) UNION SELECT r.query_id, origin, needed FROM req r JOIN need n ON n.node_id = r.node_id)",
        "ok AS (SELECT r.query_id, origin, bool_and(s.node_id IS NOT NULL) AS ok FROM req r LEFT JOIN sel s ON s.query_id = r.query_id AND s.node_id = r.node_id WHERE r.node_id <> origin GROUP BY 1, 2)")
    + "SELECT query_id, round(avg(ok::INTEGER), 9) AS dependency_completeness FROM (SELECT DISTINCT query_id FROM sel) LEFT JOIN ok USING (query_id) GROUP BY 1",
)
def dependency_completeness(spark, sf):
    nodes, edges = P.graph(spark, sf)
    seeds = _seeds(spark, sf)
    order = F.substring_index(F.expr("substring(node_id, 2)"), ":", 1)
    figures = seeds.where(order.cast("long") % 2 == 0).select("query_id", F.concat(F.lit("o"), order).alias("node_id"))
    out = graph.dependency_completeness(seeds.unionByName(figures).distinct(), nodes, edges)
    return out.withColumn("dependency_completeness", F.round("dependency_completeness", 9))


_TREES = "SELECT s.query_id, c.paper_id, list_sort(list(c.node_id)) AS node_ids, round(sum(coalesce(score, 0)), 9) AS relevance, sum(cost)::BIGINT AS cost FROM {0} s JOIN cost c USING (node_id) LEFT JOIN hits h ON h.query_id = s.query_id AND h.node_id = s.node_id GROUP BY 1, 2"


def _shown(trees):
    return trees.select("query_id", "paper_id", "node_ids", F.round("relevance", 9).alias("relevance"), "cost")


def _setting(spark, sf):
    """Hits, nodes, edges and queries as written tables, as an ingest leaves them: selection reads them many times."""
    written = Scratch(spark, "graph")
    nodes, edges = P.graph(spark, sf)
    return written.write(P.graph_hits(spark, sf)), written.write(nodes), written.write(edges), P.graph_queries(spark, sf)


@query("select_top_k", cte(GRAPH, SELECTED) + _TREES.format("seed"))
def select_top_k(spark, sf):
    return _shown(select.retrieve("top_k", *_setting(spark, sf)))


@query("select_one_hop", cte(GRAPH, SELECTED) + _TREES.format("hop"))
def select_one_hop(spark, sf):
    return _shown(select.retrieve("one_hop", *_setting(spark, sf)))


_PPR = cte(GRAPH,
        "v AS (SELECT query_id, node_id, pos, score, score / sum(score) OVER (PARTITION BY query_id) AS p FROM hits)",
        "e AS (SELECT DISTINCT x.query_id, x.node_id AS a, y.node_id AS b FROM v x JOIN sym ON sym.a = x.node_id JOIN v y ON y.query_id = x.query_id AND y.node_id = sym.b WHERE sym.a <> sym.b)",
        "d AS (SELECT query_id, a, count(*) AS n FROM e GROUP BY 1, 2)",
        """it AS (SELECT query_id, map(list(node_id ORDER BY pos), list(p ORDER BY pos)) AS x, 0 AS i FROM v GROUP BY 1
          UNION ALL SELECT it.query_id, (SELECT map(list(v.node_id ORDER BY v.pos), list((0.15 + 0.85 * coalesce((SELECT sum(it.x[w.node_id]) FROM v w WHERE w.query_id = it.query_id AND NOT EXISTS (SELECT 1 FROM d WHERE d.query_id = w.query_id AND d.a = w.node_id)), 0)) * v.p
             + 0.85 * coalesce((SELECT sum(it.x[e.a] / d.n) FROM e JOIN d ON d.query_id = e.query_id AND d.a = e.a WHERE e.query_id = v.query_id AND e.b = v.node_id), 0) ORDER BY v.pos)) FROM v WHERE v.query_id = it.query_id), i + 1 FROM it WHERE i < 50)""")


@query(
    "ppr_rank",
    _PPR + "SELECT v.query_id, v.node_id, round(it.x[v.node_id], 6) AS score FROM v JOIN it ON it.query_id = v.query_id AND it.i = 50",
)
def ppr_rank(spark, sf):
    out = select.ppr_ranked(P.graph_hits(spark, sf), P.graph(spark, sf)[1])
    return out.select("query_id", "node_id", F.round("score", 6).alias("score"))


@query(
    "select_ppr",
    _PPR + ", top AS (SELECT query_id, node_id, s FROM (SELECT v.query_id, v.node_id, it.x[v.node_id] AS s, row_number() OVER (PARTITION BY v.query_id ORDER BY round(it.x[v.node_id], 9) DESC, v.pos) AS k FROM v JOIN it ON it.query_id = v.query_id AND it.i = 50) WHERE k <= 10) "
    "SELECT query_id, paper_id, list_sort(list(node_id)) AS node_ids, round(sum(s), 6) AS relevance, sum(cost)::BIGINT AS cost FROM top JOIN cost USING (node_id) GROUP BY 1, 2",
)
def select_ppr(spark, sf):
    return _shown(select.retrieve("ppr", *_setting(spark, sf))).withColumn("relevance", F.round("relevance", 6))


@query(
    "pcst_fallback",
    cte(GRAPH,
        "s AS (SELECT DISTINCT query_id, paper_id AS p, node_id FROM hits)",
        "ex AS (SELECT query_id, p, node_id, 0 AS h FROM s UNION SELECT ex.query_id, p, b, h + 1 FROM ex JOIN sym ON a = ex.node_id AND confidence >= 0.8 WHERE h < 2)",
        "own AS (SELECT DISTINCT ex.query_id, p, ex.node_id FROM ex JOIN nodes n ON n.node_id = ex.node_id AND n.paper_id = p)")
    + "SELECT o.query_id, p AS paper_id, list_sort(list(o.node_id)) AS node_ids FROM own o JOIN hits h ON h.query_id = o.query_id AND h.node_id = o.node_id AND score > 0 GROUP BY 1, 2",
)
def pcst_fallback(spark, sf):
    hits, nodes, edges, _ = _setting(spark, sf)
    return select.skeletons(hits, nodes, edges, (1.0,), "fallback").select("query_id", "paper_id", "node_ids")


@query("pcst_single_scorer", cte(GRAPH) + "SELECT query_id, paper_id, [min_by(node_id, pos)] AS node_ids FROM hits GROUP BY 1, 2")
def pcst_single_scorer(spark, sf):
    """With scores of one scorer's reciprocal ranks no moat reaches the cheapest edge: each paper's tree is its best hit."""
    hits, nodes, edges, _ = _setting(spark, sf)
    return select.skeletons(hits.withColumn("score", 1.0 / (60 + F.col("pos"))), nodes, edges, (0.5,)).select("query_id", "paper_id", "node_ids")


@query("pcst_gw")
def pcst_gw(spark, sf):
    hits, nodes, edges, queries = _setting(spark, sf)
    return _shown(select.retrieve("pcst", hits.withColumn("score", F.col("score") * 50), nodes, edges, queries))


@query("pcst_closure")
def pcst_closure(spark, sf):
    hits, nodes, edges, queries = _setting(spark, sf)
    return _shown(select.retrieve("pcst_closure", hits.withColumn("score", F.col("score") * 50), nodes, edges, queries))


@query("ec_bfr_forest")
def ec_bfr_forest(spark, sf):
    hits, nodes, edges, queries = _setting(spark, sf)
    return _shown(select.retrieve("ec_bfr", hits.withColumn("score", F.col("score") * 50), nodes, edges, queries))


@query("forest_union_cost", cte(GRAPH, SELECTED) + "SELECT query_id, count(*) AS n_nodes, sum(cost)::BIGINT AS total_cost FROM closed JOIN cost USING (node_id) GROUP BY 1")
def forest_union_cost(spark, sf):
    nodes, edges = P.graph(spark, sf)
    closed = graph.closure(_seeds(spark, sf), nodes, edges)
    return select.union_cost(closed, nodes)


_SLOTS = """
t AS (SELECT query_id, lower(coalesce(text, '')) AS low FROM closed JOIN nodes USING (node_id)),
w AS (SELECT query_id, 'metric' AS slot, 'units' AS v FROM hits UNION SELECT query_id, 'unit', 'priority' FROM hits UNION SELECT query_id, 'value', query_id || '.0' FROM hits UNION SELECT query_id, 'conditions', 'urgent' FROM hits UNION SELECT query_id, 'conditions', 'total' FROM hits),
f AS (SELECT query_id, 'answer' AS slot FROM t WHERE trim(low) <> '' UNION SELECT t.query_id, slot FROM t JOIN w ON t.query_id = w.query_id AND contains(low, v))
"""


@query("covered_slots", cte(GRAPH, SELECTED, _SLOTS) + "SELECT query_id, list_sort(list(DISTINCT slot)) AS slots FROM f GROUP BY 1")
def covered_slots(spark, sf):
    nodes, edges = P.graph(spark, sf)
    rows = graph.closure(_seeds(spark, sf), nodes, edges).join(select.costed(nodes), "node_id").withColumn("ord", F.lit(0))
    return select.covered_slots(rows, P.graph_queries(spark, sf)).select("query_id", "slots")


@query("entities_union", cte(GRAPH, SELECTED) + "SELECT query_id, list_sort(list(DISTINCT e)) AS entities FROM (SELECT query_id, unnest(['customer ' || paper_id, lower(node_type)]) AS e FROM closed JOIN nodes USING (node_id)) GROUP BY 1")
def entities_union(spark, sf):
    nodes, edges = P.graph(spark, sf)
    tagged = nodes.withColumn("entities", F.array(F.concat(F.lit("customer "), F.col("paper_id")), F.lower("node_type")))
    return select.entities_of(graph.closure(_seeds(spark, sf), nodes, edges), tagged)


# ------------------------------------------------------------------------------------------------ building


@query("next_sentence_edges", cte(SENTENCES) + "SELECT src, dst FROM (SELECT node_id AS src, lead(node_id) OVER (PARTITION BY doc_id ORDER BY ord) AS dst FROM sentence) WHERE dst IS NOT NULL")
def next_sentence_edges(spark, sf):
    s = P.sentences(P.table(spark, sf, "documents"))
    nodes = s.select("node_id", F.col("doc_id").cast("string").alias("paper_id"), "node_type", F.col("ord").alias("source_index"), F.lit(0).alias("part"))
    return build.next_sentences(nodes).select("src", "dst")


@query(
    "figure_text_views",
    cte(GRAPH, "l AS (SELECT DISTINCT dst, first_value(src) OVER (PARTITION BY dst, text ORDER BY src) AS src, text FROM edges JOIN nodes ON node_id = src WHERE relation IN ('caption_of', 'refers_to', 'derived_from') AND trim(text) <> '')")
    + "SELECT node_id, coalesce((SELECT string_agg(l.text, chr(10) ORDER BY l.src) FROM l WHERE l.dst = nodes.node_id), '') AS text_view FROM nodes WHERE node_type = 'Figure'",
)
def figure_text_views(spark, sf):
    return build.figure_text_views(*P.graph(spark, sf))


#: What the layout blocks of every order become (projections.layout_blocks).
_PAPERS = "o AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS p, o_orderpriority AS prio, o_orderstatus AS st FROM orders)"
_UNION = " UNION ALL SELECT "


@query("caption_label_join", cte(
    "c AS (SELECT o_custkey AS p, o_orderkey AS k, (o_orderkey % 3)::VARCHAR AS label, o_orderkey % 2 = 0 AS tab FROM orders)",
    "f AS (SELECT p, label, tab, max(k) AS k FROM c GROUP BY 1, 2, 3)", "s AS (SELECT p, label, tab, max(k) AS k FROM c WHERE k % 5 <> 0 GROUP BY 1, 2, 3)",
) + "SELECT 'c' || s.k AS src, 't' || f.k AS dst, 'caption_of' AS relation FROM s JOIN f USING (p, label, tab)")
def caption_label_join(spark, sf):
    """A customer is a paper, an order a figure or table and (four of five) its caption; labels recur, and the later block has one."""
    o = P.table(spark, sf, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Table").otherwise("Figure")
    common = (F.col("o_custkey").cast("string").alias("paper_id"), F.col("o_orderkey").alias("source_index"), (F.col("o_orderkey") % 3).cast("string").alias("label"))
    targets = o.select(F.concat(F.lit("t"), "k").alias("node_id"), kind.alias("node_type"), F.lit(None).cast("string").alias("caption_target"), *common)
    captions = o.where("o_orderkey % 5 <> 0").select(F.concat(F.lit("c"), "k").alias("node_id"), F.lit("Caption").alias("node_type"), F.lower(kind).alias("caption_target"), *common)
    return build.labelled_captions(targets.unionByName(captions)).select("src", "dst", "relation")


@query("refers_to_join", cte(_PAPERS) + "SELECT p || ':sentence:2:0' AS src, p || ':figure:1' AS dst, 'refers_to' AS relation FROM o WHERE k % 4 <> 0" + _UNION + "p || ':sentence:4:0', p || ':table:3', 'refers_to' FROM o")
def refers_to_join(spark, sf):
    return build.references(build.blocks_to_nodes(build.routed(P.layout_blocks(spark, sf)))).select("src", "dst", "relation")


@query("nearest_caption", cte(_PAPERS) + "SELECT p || ':caption:1:embedded' AS src, p || ':figure:1' AS dst, 1.0::DOUBLE AS confidence FROM o WHERE k % 4 <> 0" + _UNION + "p || ':caption:3:table', p || ':table:3', 1.0 FROM o" + _UNION + "p || ':caption:6', p || ':figure:5', 0.9 FROM o WHERE k % 5 = 0")
def nearest_caption(spark, sf):
    """All caption edges of the blocks: embedded, of tables, and those paired by reading order."""
    _, edges, _ = build.blocks_to_graph(P.layout_blocks(spark, sf))
    return edges.where("relation = 'caption_of'").select("src", "dst", "confidence")


@query("blocks_to_nodes", cte(_PAPERS) + _UNION.join([
    "SELECT p || ':sentence:0:0' AS node_id, 'Sentence' AS node_type, 'Order ' || k AS text, NULL::VARCHAR AS image_path, 1 AS page FROM o",
    "p || ':figure:1', 'Figure', NULL, 'base/f' || k || '.png', 1 FROM o WHERE k % 4 <> 0",
    "p || ':caption:1:embedded', 'Caption', 'Figure 1. Priority ' || prio || '.', NULL, 1 FROM o WHERE k % 4 <> 0",
    "p || ':sentence:2:0', 'Sentence', 'As shown in Fig. 1, sales grow.', NULL, 1 FROM o",
    "p || ':sentence:2:1', 'Sentence', 'They grow fast in order ' || k || '.', NULL, 1 FROM o",
    "p || ':table:3', 'Table', 'Table 2. Lines' || chr(10) || 'Key' || chr(9) || 'Status' || chr(10) || k || chr(9) || st, NULL, 2 FROM o",
    "p || ':caption:3:table', 'Caption', 'Table 2. Lines', NULL, 2 FROM o",
    "p || ':sentence:4:0', 'Sentence', 'Table 2 reports status ' || st || '.', NULL, 2 FROM o",
    "p || ':figure:5', 'Figure', NULL, 'base/a.png', 3 FROM o WHERE k % 5 = 0",
    "p || ':caption:6', 'Caption', 'Left: ' || prio || '.', NULL, 3 FROM o WHERE k % 5 = 0",
]))
def blocks_to_nodes(spark, sf):
    nodes, _, _ = build.blocks_to_graph(P.layout_blocks(spark, sf), "base")
    return nodes.select("node_id", "node_type", "text", "image_path", "page")


@query("layout_warnings", cte(_PAPERS) + "SELECT p AS paper_id, '1' AS parser_block_id, 'figure without image' AS warning FROM o WHERE k % 4 = 0")
def layout_warnings(spark, sf):
    return build.blocks_to_graph(P.layout_blocks(spark, sf))[2]


_HTML = r"regexp_extract_all(html, '(?s)<(h1|p)>(.*?)</(h1|p)>', 2)"


@query(
    "pages_to_sentences",
    cte("b AS (SELECT page_id AS doc_id, 'p' AS source, unnest(" + _HTML + ") AS text, generate_subscripts(" + _HTML + ", 1) - 1 AS idx FROM pages)",
        SENTENCES.replace("SELECT doc_id, source, regexp_replace(trim(", "SELECT doc_id || ':sentence:' || idx AS doc_id, source, regexp_replace(trim(").replace("FROM documents", "FROM b"))
    + "SELECT 'page' || node_id AS node_id, text FROM sentence",
)
def pages_to_sentences(spark, sf):
    """Headings and paragraphs of web pages as layout blocks."""
    found = F.regexp_extract_all("html", F.lit("(?s)<(h1|p)>(.*?)</(h1|p)>"), F.lit(2))
    rows = P.table(spark, sf, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("paper_id"), F.posexplode(found).alias("index", "t"))
    blocks = rows.select("paper_id", "index", F.to_json(F.struct(F.lit("text").alias("type"), F.col("t").alias("text"))).alias("block"))
    return build.blocks_to_nodes(build.routed(blocks)).select("node_id", "text")


@query(
    "serialize_forest",
    cte(GRAPH, SELECTED, "o AS (SELECT query_id, paper_id, dense_rank() OVER (PARTITION BY query_id ORDER BY paper_id) AS tree, node_type, node_id, '[' || node_id || '] ' || node_type || ' (page=unknown' || CASE WHEN node_type = 'Figure' THEN '); text_view=' ELSE '): ' || coalesce(text, '') END AS line, image_path FROM closed JOIN nodes USING (node_id))",
        "p AS (SELECT query_id, tree, '## Evidence component ' || tree || '; paper=' || paper_id || chr(10) || string_agg(line, chr(10) ORDER BY node_type, node_id) AS text FROM o GROUP BY query_id, tree, paper_id)",
        "i AS (SELECT query_id, list(image_path ORDER BY tree, node_type, node_id) AS image_paths FROM o WHERE node_type = 'Figure' GROUP BY 1)")
    + "SELECT query_id, string_agg(text, chr(10) ORDER BY tree) AS context, coalesce(first(image_paths), []) AS image_paths FROM p LEFT JOIN i USING (query_id) GROUP BY 1",
)
def serialize_forest(spark, sf):
    nodes, edges = P.graph(spark, sf)
    closed = graph.closure(_seeds(spark, sf), nodes, edges).join(nodes.select("node_id", "paper_id"), "node_id")
    trees = closed.groupBy("query_id", "paper_id").agg(F.collect_list("node_id").alias("node_ids"))
    trees = trees.withColumn("tree", F.row_number().over(Window.partitionBy("query_id").orderBy("paper_id")))
    return build.serialized(trees, nodes)


# ------------------------------------------------------------------------------------------------ mapping, charts, mining


@query("evidence_mapping_fuzzy")
def evidence_mapping_fuzzy(spark, sf):
    """Every fiftieth benchmark passage as evidence in the sentences of all documents."""
    nodes = P.sentences(P.table(spark, sf, "documents")).withColumn("paper_id", F.lit("all")).withColumn("ord", F.col("doc_id") * 1000000 + F.col("ord"))
    e = P.table(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("evidence_id"), F.lit("all").alias("paper_id"), F.col("text").alias("evidence"))
    return mapping.map_evidence(e, nodes).withColumn("score", F.round("score", 9))


@query("chart_self_ensemble", """SELECT 'o' || o_orderkey AS figure_id, 'x,y' || chr(13) || chr(10) || '1,' || (o_custkey % 1000 + 1) || chr(13) || chr(10) || 'total,' || (o_orderkey % 1000) AS linearized_table,
    CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 1.0 / 3 END::DOUBLE AS uncertainty, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 1 - 1.0::DOUBLE / 3 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'suspect' END AS parse_status FROM orders""")
def chart_self_ensemble(spark, sf):
    """Three readings of a chart for every order, alike or with one cell apart, whose marks and rules differ."""
    o = P.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("sample"))
    value = (F.col("o_custkey") % 1000 + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(F.col("sample"))).cast("string")
    total = (F.col("o_orderkey") % 1000).cast("string")
    marked = F.concat(F.lit("|x|y|\n|--|--|\n|1|"), value, F.lit("|\n|total|"), total, F.lit("|"))
    read = F.when(F.col("sample") == 1, marked).otherwise(F.concat(F.lit("x,y\n1,"), value, F.lit("\ntotal,"), total))
    return charts.self_ensemble(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("figure_id"), "sample", read.alias("linearized_table")))


@query(
    "hard_negatives",
    """WITH v AS (SELECT vec_id, label, label % 5 AS t, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, v.* FROM v q JOIN v ON v.label = q.label WHERE q.vec_id % 50 = 0),
    n AS (SELECT p.query_id, p.vec_id AS p, v.vec_id AS n, v.t <> p.t AS other, round(list_inner_product(p.e, v.e), 9) AS s FROM p JOIN v ON v.label <> p.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY other, s DESC, n::VARCHAR) AS k FROM n)
    SELECT query_id, p::VARCHAR AS positive_node_id, n::VARCHAR AS negative_node_id FROM r WHERE k = 1""",
)
def hard_negatives(spark, sf):
    """Every fiftieth vector asks; its positives are those of its label, its pool is all others. Vectors of a label ask the same, so negatives are looked for once a label."""
    v = P.vectors(P.table(spark, sf, "embeddings"))
    asked = v.where("ord % 50 = 0").select(F.col("ord").alias("query_id"), F.col("label").alias("l"))
    labels = asked.select("l").distinct()
    positives = labels.join(v, F.col("l") == F.col("label")).select(F.col("l").alias("query_id"), "node_id")
    others = labels.join(v.select(F.col("label").alias("other")).distinct(), F.col("l") != F.col("other"))
    pool = others.join(v, F.col("label") == F.col("other")).select(F.col("l").alias("query_id"), "node_id")
    found = mining.hard_negatives(positives, pool, v).withColumnRenamed("query_id", "l")
    return asked.join(found, "l").select("query_id", "positive_node_id", "negative_node_id")


@query(
    "relation_triples",
    cte(GRAPH, "k AS (SELECT DISTINCT src, dst, s.paper_id, d.node_type AS t FROM edges JOIN nodes s ON s.node_id = src JOIN nodes d ON d.node_id = dst)",
        "c AS (SELECT paper_id, node_type AS t, node_id, row_number() OVER (PARTITION BY paper_id, node_type ORDER BY sha1('42|' || node_id), node_id) - 1 AS place, count(*) OVER (PARTITION BY paper_id, node_type) AS size FROM nodes)",
        "f AS (SELECT k.src, k.dst, c.node_id, (c.place - ('0x' || substr(sha1('42|' || k.src || '|' || k.dst), 1, 8))::BIGINT % size + size) % size AS turn FROM k JOIN c USING (paper_id, t) WHERE c.node_id <> k.src AND NOT EXISTS (SELECT 1 FROM k z WHERE z.src = k.src AND z.dst = c.node_id))")
    + "SELECT src, dst, min_by(node_id, turn) AS negative FROM f GROUP BY 1, 2",
)
def relation_triples(spark, sf):
    nodes, edges = P.graph(spark, sf)
    return mining.relation_triples(nodes, edges, nodes.select("paper_id"))


@query("hetero_index", cte(GRAPH) + 'SELECT node_id, node_type, row_number() OVER (PARTITION BY node_type ORDER BY node_id) - 1 AS "index" FROM nodes')
def hetero_index(spark, sf):
    return mining.typed_index(P.graph(spark, sf)[0])


# ------------------------------------------------------------------------------------------------ systems and small functions


@query("system_metrics")
def system_metrics(spark, sf):
    """The systems that need no model from outside, over vectors as nodes, gold by label, macro means of all metrics."""
    from . import systems

    e = P.table(spark, sf, "embeddings")
    v = P.vectors(e)
    nodes = v.select("node_id", "paper_id", "node_type", F.concat(F.lit("vector "), "node_id").alias("text"), F.when(F.col("node_type") == "Figure", F.concat("node_id", F.lit(".png"))).alias("image_path"))
    w = Window.partitionBy("paper_id").orderBy("ord")
    edges = v.select(F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.lit("next_sentence").alias("relation"), F.lit(1.0).alias("confidence")).where("dst IS NOT NULL")
    written = Scratch(spark, "systems")
    nodes, edges = written.write(nodes), written.write(edges)
    asked = P.vector_queries(e).withColumn("query", F.lit("vector"))
    gold = asked.select("query_id", "label").join(v.select("node_id", "label"), "label").select("query_id", "node_id")
    chosen = {k: x for k, x in systems.SYSTEMS.items() if not (x.rerank or x.graph_scores)}
    return systems.benchmark(chosen, asked, gold, nodes, edges, v)


@query("index_report", cte(GRAPH) + "SELECT count(*) FILTER (node_type NOT IN ('Figure', 'Table')) AS text_nodes, count(*) FILTER (node_type = 'Figure') AS figure_nodes, count(*) FILTER (node_type = 'Table') AS table_nodes, 64 AS dimension FROM nodes")
def index_report(spark, sf):
    return reports.index_report(P.graph(spark, sf)[0], 64)


@query("embedding_inputs", cte(GRAPH) + "SELECT node_id, CASE WHEN node_type = 'Figure' THEN 'image' ELSE 'text' END AS how, text, image_path AS image FROM nodes")
def embedding_inputs(spark, sf):
    return reports.embedding_inputs(P.graph(spark, sf)[0])


_DROPPED = "CASE o_orderstatus WHEN 'F' THEN 'unanswerable' WHEN 'P' THEN 'unmapped' END"


@query("preparation_report", cte(GRAPH) + f"""SELECT 'papers' AS name, count(DISTINCT paper_id) AS value FROM nodes UNION ALL SELECT 'nodes.' || node_type, count(*) FROM nodes GROUP BY 1 UNION ALL SELECT 'edges.' || relation, count(*) FROM edges GROUP BY 1
    UNION ALL SELECT 'samples', count(*) FROM orders WHERE {_DROPPED} IS NULL UNION ALL SELECT 'dropped.' || d, count(*) FROM (SELECT {_DROPPED} AS d FROM orders) WHERE d IS NOT NULL GROUP BY 1""")
def preparation_report(spark, sf):
    """The orders' graph as a prepared set whose samples are the orders."""
    s = F.col("o_orderstatus")
    samples = P.table(spark, sf, "orders").select(F.when(s == "F", "unanswerable").when(s == "P", "unmapped").alias("dropped"))
    return reports.preparation_report(*P.graph(spark, sf), samples)


@query("run_summary", """WITH r AS (SELECT event_type AS dataset, 's' || (event_id % 2) AS split, 'r' || (event_id % 7) AS run, 'm' || (event_id % 5) AS metric, value FROM events WHERE value IS NOT NULL),
    b AS (SELECT dataset, split, metric, max(value) AS value FROM r GROUP BY 1, 2, 3), n AS (SELECT dataset, split, max(c) AS runs FROM (SELECT dataset, split, metric, count(DISTINCT run) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT dataset, split, runs, metric, min(run) AS best_run FROM b JOIN r USING (dataset, split, metric, value) JOIN n USING (dataset, split) GROUP BY 1, 2, 3, 4""")
def run_summary(spark, sf):
    """Events as runs' values of metrics."""
    e, part = P.table(spark, sf, "events").where("value IS NOT NULL"), lambda mark, n: F.concat(F.lit(mark), (F.col("event_id") % n).cast("string"))
    made = reports.run_summary(e.select(F.col("event_type").alias("dataset"), part("s", 2).alias("split"), part("r", 7).alias("run"), part("m", 5).alias("metric"), "value"))
    return made.select("dataset", "split", "runs", F.explode("best_runs").alias("metric", "best_run"))


@query("point_ids", "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INTEGER % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR)) AS h FROM documents)")
def point_ids(spark, sf):
    from ..functions.text import uuid5_of

    return P.table(spark, sf, "documents").select("doc_id", uuid5_of(F.col("doc_id").cast("string")).alias("point_id"))
