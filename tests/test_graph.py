"""Graph operators, selection and metrics on hand-made graphs."""

import math

import numpy as np
import pytest

from lumenfold.operators import build, charts, evaluate, fusion, graph, mapping, mining, recall, select, trees

NODES = "node_id string, paper_id string, node_type string, text string, image_path string"
EDGES = "src string, dst string, relation string, confidence double"


@pytest.fixture(scope="module")
def closing(spark):
    """Sentence, figure, caption, chart data, table and its caption."""
    nodes = [("s1", "Sentence"), ("f1", "Figure"), ("c1", "Caption"), ("d1", "ChartData"), ("t1", "Table"), ("tc1", "Caption")]
    rows = [(f"p:{n}", "p", k, None if k == "Figure" else n, "f.png" if k == "Figure" else None) for n, k in nodes]
    edges = [("s1", "f1", "refers_to"), ("c1", "f1", "caption_of"), ("d1", "f1", "derived_from"), ("tc1", "t1", "caption_of")]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(f"p:{a}", f"p:{b}", r, 1.0) for a, b, r in edges], EDGES)


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, node_id string")


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.node_id.split(":")[1])
    return out


def test_closure(spark, closing):
    got = graph.closure(seeds(spark, (1, "p:s1"), (2, "p:d1"), (3, "p:t1"), (4, "p:s1"), (4, "p:f1"), (4, "p:c1")), *closing)
    assert sets(got) == {1: {"s1", "f1", "c1"}, 2: {"d1", "f1", "c1"}, 3: {"t1", "tc1"}, 4: {"s1", "f1", "c1"}}


def test_closure_of_chains_and_cycles(spark):
    """A sentence refers to a sentence that refers to a figure; chart data derives from chart data; two sentences refer to each other."""
    nodes = [("s1", "Sentence"), ("s2", "Sentence"), ("s3", "Sentence"), ("f", "Figure"), ("c", "Caption"), ("d1", "ChartData"), ("d2", "ChartData")]
    edges = [("s1", "s2", "refers_to"), ("s2", "f", "refers_to"), ("c", "f", "caption_of"), ("d1", "d2", "derived_from"), ("d2", "f", "derived_from"), ("s3", "s1", "refers_to"), ("s1", "s3", "refers_to")]
    args = spark.createDataFrame([(f"p:{n}", "p", k, n, "f.png") for n, k in nodes], NODES), spark.createDataFrame([(f"p:{a}", f"p:{b}", r, 1.0) for a, b, r in edges], EDGES)
    got = graph.closure(seeds(spark, (1, "p:s2"), (2, "p:s1"), (3, "p:d1"), (4, "p:c")), *args)
    assert sets(got) == {1: {"s2", "f", "c"}, 2: {"s1", "s2", "s3", "f", "c"}, 3: {"d1", "d2", "f", "c"}, 4: {"c"}}
    assert [r.closure_validity for r in graph.closure_validity(got, *args).collect()] == [1.0] * 4


@pytest.mark.parametrize("off, want", [("figure_needs_caption", {"s1": {"s1", "f1"}, "d1": {"d1", "f1"}, "t1": {"t1", "tc1"}}), ("table_needs_caption", {"s1": {"s1", "f1", "c1"}, "t1": {"t1"}}), ("chart_needs_source", {"d1": {"d1"}, "s1": {"s1", "f1", "c1"}}), ("sentence_needs_target", {"s1": {"s1"}, "d1": {"d1", "f1", "c1"}})])
def test_closure_policy(spark, closing, off, want):
    names = list(want)
    got = sets(graph.closure(seeds(spark, *[(i, f"p:{n}") for i, n in enumerate(names)]), *closing, graph.Policy(**{off: False})))
    assert got == {i: want[n] for i, n in enumerate(names)}
    nothing = graph.Policy(False, False, False, False)
    assert sets(graph.closure(seeds(spark, (1, "p:s1")), *closing, nothing)) == {1: {"s1"}}


def test_closure_of_unknown_seed(spark, closing):
    with pytest.raises(Exception):
        graph.closure(seeds(spark, (1, "p:zz")), *closing).collect()


def test_validity_and_completeness(spark, closing):
    s = seeds(spark, (1, "p:s1"), (2, "p:f1"), (2, "p:c1"), (3, "p:s1"), (3, "p:f1"), (3, "p:c1"), (4, "p:tc1"), (5, "p:s1"), (5, "p:t1"), (5, "p:tc1"))
    v = {r.query_id: r.closure_validity for r in graph.closure_validity(s, *closing).collect()}
    c = {r.query_id: r.dependency_completeness for r in graph.dependency_completeness(s, *closing).collect()}
    assert v == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.0} and c == {1: 0.0, 2: 1.0, 3: 1.0, 4: None, 5: 0.5}


def test_expand_threshold_is_inclusive_and_crosses_papers(spark):
    edges = spark.createDataFrame([("a", "b", "next_sentence", 0.8), ("c", "b", "next_sentence", 0.79), ("b", "d", "refers_to", 1.0)], EDGES)
    got = lambda h: {r.node_id for r in graph.expand(seeds(spark, (1, "a")), edges, h).collect()}
    assert got(0) == {"a"} and got(1) == {"a", "b"} and got(2) == {"a", "b", "d"}


def test_integrity_and_merge(spark, closing):
    nodes, edges = closing
    assert graph.dangling_edges(nodes, edges).count() == 0
    assert graph.dangling_edges(nodes.where("node_id <> 'p:f1'"), edges).count() == 3
    assert graph.merged_nodes([nodes, nodes.where("node_type = 'Caption'")]).count() == 6
    with pytest.raises(Exception):
        graph.merged_nodes([nodes, spark.createDataFrame([("p:s1", "p", "Sentence", "other", None)], NODES)]).collect()
    bad = spark.createDataFrame([("", "p", "Sentence", "x", None), ("a", "p", "Figure", None, None), ("b", "p", "Table", "", ""), ("c", "p", "Odd", "x", None)], NODES).selectExpr("*", "2.0D AS confidence")
    assert {r.node_id: set(r.reasons) for r in graph.invalid_nodes(bad).collect()} == {"": {"node_id", "confidence"}, "a": {"figure without image", "confidence"}, "b": {"table without text or image", "confidence"}, "c": {"node_type", "confidence"}}


HITS = "query_id int, node_id string, paper_id string, score double, pos int"


def test_selection_methods(spark):
    nodes = spark.createDataFrame([("p:s", "p", "Sentence", "as drawn", None), ("p:f", "p", "Figure", None, "figure.png"), ("p:c", "p", "Caption", "What was drawn", None)], NODES)
    edges = spark.createDataFrame([("p:s", "p:f", "refers_to", 1.0), ("p:c", "p:f", "caption_of", 1.0)], EDGES)
    hits, queries = spark.createDataFrame([(1, "p:s", "p", 1.0, 1)], HITS), spark.createDataFrame([(1,)], "query_id int")
    got = {m: set(select.retrieve(m, hits, nodes, edges, queries, top_k=1).first().node_ids) for m in select.METHODS}
    assert got["top_k"] == got["ppr"] == {"p:s"} and got["one_hop"] == {"p:s", "p:f"} and got["pcst_closure"] == got["ec_bfr"] == {"p:s", "p:f", "p:c"}
    with pytest.raises(ValueError):
        select.retrieve("other", hits, nodes, edges, queries)
    with pytest.raises(ValueError):
        select.ranked_selection(hits, nodes, edges, 0)


def test_forest_keeps_the_budget(spark):
    nodes, edges, hits = [], [], []
    for i, p in enumerate(("p1", "p2")):
        nodes += [(f"{p}:s", p, "Sentence", "beam at 500 MPa", None), (f"{p}:f", p, "Figure", None, "f.png"), (f"{p}:c", p, "Caption", "Figure 1. bending", None)]
        edges += [(f"{p}:s", f"{p}:f", "refers_to", 1.0), (f"{p}:c", f"{p}:f", "caption_of", 1.0)]
        hits.append((1, f"{p}:s", p, 1.0 - i / 10, i + 1))
    args = spark.createDataFrame(hits, HITS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1, "500", "MPa")], "query_id int, value string, unit string")
    for budget, n in ((80, 2), (30, 1), (10, 0)):
        rows = select.retrieve("ec_bfr", *args, budget=budget, image_unit=20, scales=(1.0,)).collect()
        assert len(rows) == n and all(r.cost == 27 and any(x.endswith(":f") for x in r.node_ids) for r in rows)


def test_prize_trees():
    assert trees.prize_tree([], {}, {}) == set()
    path = {("a", "b"): 1.0, ("b", "c"): 1.0}
    assert trees.prize_tree("abc", {"a": 5.0, "c": 5.0}, path) == {"a", "b", "c"}
    assert trees.prize_tree("abc", {"a": 5.0, "c": 0.5}, path) == {"a"}
    assert trees.prize_tree("ab", {"a": 1 / 61, "b": 1 / 62}, {("a", "b"): 0.05}) == {"a"}
    assert trees.positive_prizes({"a": 0.0, "b": -1.0}) == {"a"}
    assert trees.cheapest_pairs([("b", "a", "refers_to"), ("a", "b", "caption_of"), ("a", "a", "contains"), ("a", "c", "odd")], 0.5) == {("a", "b"): 0.05, ("a", "c"): 0.5}


def test_page_rank():
    x = trees.page_rank(np.array([1.0, 0.0, 0.0]), np.array([0, 1]), np.array([1, 0]))
    assert x.sum() == pytest.approx(1) and x[2] == 0 and x[0] == pytest.approx(0.15 / (1 - 0.85**2), abs=1e-3)
    assert trees.page_rank(np.zeros(4), np.array([], int), np.array([], int)) == pytest.approx([0.25] * 4)


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "wrong", 1), (1, "a", 2), (1, "b", 3)], "query_id int, node_id string, pos int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, node_id string")
    got = {r.query_id: r for r in evaluate.ranking_metrics(ranked, gold, (1, 3)).collect()}
    r = got[1]
    assert (r.recall_at_1, r.recall_at_3, r.joint_recall_at_3, r.mrr, r.mrr_at_10) == (0, 1, 1, 0.5, 0.5)
    assert r.ndcg_at_3 == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert got[2].mrr == got[2].recall_at_3 == 0
    with pytest.raises(ValueError):
        evaluate.ranking_metrics(ranked, gold, ())


def test_typed_and_answers(spark):
    nodes = spark.createDataFrame([("s", "Sentence"), ("f", "Figure"), ("t", "Table"), ("x", "Sentence")], "node_id string, node_type string")
    ranked = spark.createDataFrame([(1, n, i + 1) for i, n in enumerate("sxft")], "query_id int, node_id string, pos int")
    gold = spark.createDataFrame([(1, n) for n in "sft"], "query_id int, node_id string")
    got = {r.node_type: r for r in evaluate.typed_metrics(ranked, ranked.where("pos = 1"), gold, nodes, (1, 2, 3, 4)).collect()}
    assert got["Sentence"].recall_at_1 == 1 and (got["Figure"].recall_at_2, got["Figure"].recall_at_3) == (0, 1) and (got["Table"].recall_at_3, got["Table"].recall_at_4) == (0, 1)
    assert got["Caption"].recall_at_1 is None and got["Caption"].evidence_precision is None
    a = spark.createDataFrame([(1, "a b c", "a x c"), (2, "", "a"), (3, "A, b!", "a B")], "k int, prediction string, reference string")
    r = {x.k: x for x in evaluate.answer_metrics(a).collect()}
    assert r[1].rouge_l_f1 == pytest.approx(2 / 3) and r[2].rouge_l_f1 == 0 and r[3].exact_match == 1
    assert {x.k: round(x.token_f1, 9) for x in evaluate.token_f1(a, ["k"]).collect()} == {1: round(2 / 3, 9), 2: 0.0, 3: 1.0}


def test_fusion(spark):
    r = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "b", 2), (1, "y", "b", 1), (1, "y", "a", 2)], "query_id int, scorer string, node_id string, rank int")
    got = {x.node_id: x.score for x in fusion.reciprocal_rank_fusion(r).collect()}
    assert got["a"] == got["b"]
    s = spark.createDataFrame([("S", "e", 1.0), ("S", "e", 3.0), ("F", "e", 7.0)], "node_type string, scorer string, value double")
    z = sorted(x.z for x in fusion.calibrated(s, fusion.calibration(s)).collect())
    assert z == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2), 7.0])


def test_scopes(spark):
    nodes = spark.createDataFrame([("p1:s", "p1", "Sentence", "grey heron nesting sites"), ("p2:s", "p2", "Sentence", "grey heron nesting sites"), ("p1:c", "p1", "Caption", "a map of the coast"), ("p1:b", "p1", "Sentence", "  ")], "node_id string, paper_id string, node_type string, text string")
    q = spark.createDataFrame([(1, "grey nesting", ["p1"], ["p1:s"]), (2, "grey nesting", [], []), (3, "none", ["p1"], None)], "query_id int, query string, paper_ids array<string>, candidate_node_ids array<string>")
    got = [(r.query_id, r.node_id) for r in recall.bm25(q, nodes).orderBy("query_id", "pos").collect()]
    assert got == [(1, "p1:s"), (2, "p2:s"), (2, "p1:s")]
    v = spark.createDataFrame([("p:a", "p", [1.0, 0.0], 0), ("p:b", "p", [0.0, 1.0], 1), ("q:c", "q", [1.0, 0.0], 2)], "node_id string, paper_id string, vector array<double>, ord int").selectExpr("*", "'Sentence' AS node_type")
    vq = spark.createDataFrame([(1, [1.0, 0.0], ["p"], ["p:a", "p:b", "q:c"])], "query_id int, query_vector array<double>, paper_ids array<string>, candidate_node_ids array<string>")
    assert [r.node_id for r in recall.cosine(vq, v, 2).orderBy("pos").collect()] == ["p:a", "p:b"]


def test_mining(spark):
    v = spark.createDataFrame([("p:gold", "Sentence", [1.0, 0.0]), ("p:hard", "Sentence", [0.9, 0.1]), ("p:easy", "Sentence", [0.0, 1.0]), ("p:figure", "Figure", [1.0, 0.0])], "node_id string, node_type string, vector array<double>")
    pool = v.selectExpr("1 AS query_id", "node_id")
    got = mining.hard_negatives(seeds(spark, (1, "p:gold")), pool, v).first()
    assert (got.positive_node_id, got.negative_node_id) == ("p:gold", "p:hard")
    assert mining.hard_negatives(seeds(spark, (1, "p:gold"), (1, "p:easy")), pool, v).count() == 2


def test_mapping(spark):
    nodes = spark.createDataFrame([("n1", "p", "Sentence", "The model improves strength by ten percent.", 0), ("n2", "p", "Sentence", "Nothing to see here at all.", 1), ("n3", "p", "Figure", "The model improves", 2), ("n4", "q", "Sentence", "far away", 3)], "node_id string, paper_id string, node_type string, text string, ord int")
    e = spark.createDataFrame([("a", "p", "the MODEL improves strength, by ten percent"), ("b", "p", "The model improved strength by ten percents."), ("c", "p", "far away"), ("d", "p", " "), ("e", "z", "text")], "evidence_id string, paper_id string, evidence string")
    got = {r.evidence_id: r for r in mapping.map_evidence(e, nodes).collect()}
    assert (got["a"].node_id, got["a"].score, got["a"].method) == ("n1", 1.0, "exact")
    assert (got["b"].node_id, got["b"].method) == ("n1", "fuzzy") and 0.85 <= got["b"].score < 1
    assert got["c"].node_id is None and 0 < got["c"].score < 0.85
    assert (got["d"].score, got["d"].method) == (0.0, "empty") and got["e"].node_id is None


def test_charts(spark):
    rows = [("f", i, f"x,y\n1,{v}\n2,20") for i, v in enumerate((10, 12, 11))]
    r = charts.self_ensemble(spark.createDataFrame(rows, "figure_id string, sample int, linearized_table string")).first()
    assert "1,11" in r.linearized_table and "2,20" in r.linearized_table and r.uncertainty > 0
    with pytest.raises(ValueError):
        charts.checked_repeats(1)


def test_chart_readings_meet_once(spark):
    """One shuffle merges readings: modal shapes, short rows, ties, quotes, empty tables, numbers that are none."""
    rows = [("a", 2, "x,y\n1,5"), ("a", 0, "x,y\n1,7"), ("a", 1, "x\n2"), ("b", 0, 'k,"p, q"\nnan,1%'), ("b", 1, 'K,"p, q"\nnan,"1,000"'), ("c", 0, ""), ("c", 1, None), ("d", 0, "u,v,w\n3"), ("d", 1, "u,v,w\n4")]
    df = charts.self_ensemble(spark.createDataFrame(rows, "figure_id string, sample int, linearized_table string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.figure_id: (r.linearized_table, r.uncertainty, r.parse_status) for r in df.collect()}
    assert got == {"a": ("x,y\r\n1,6", 0.5, "suspect"), "b": ('k,"p, q"\r\nnan,500.5', 0.5, "suspect"), "c": ("", 1.0, "suspect"), "d": ("u,v,w\r\n3.5,,", 1.0, "suspect")}


def test_blocks_are_read_once(spark):
    """A block's fields come from one reading of its JSON; places within `content` only where that is an object."""
    blocks = ['{"type":"image","content":{"img_path":"q.png"},"img_caption":["a","","b"]}', '{"type":"table","content":"{\\"html\\":\\"<p>x</p>\\"}"}', '{"type":"image","content":{"image_source":{"path":"z.png"}}}', "not json", None]
    routed = build.routed(spark.createDataFrame([("p", i, b) for i, b in enumerate(blocks)], "paper_id string, index int, block string"))
    assert "$.type" not in routed._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.kind, r.image_path, r.image_caption, r.body) for r in routed.orderBy("index").collect()] == [("image", "q.png", "a b", None), ("table", None, "", ""), ("image", "z.png", "", None), (None, None, "", None), (None, None, "", None)]


def test_pages_are_paired_in_batches(spark):
    """Captions and targets of many pages go to Python together, not a page at a time; a page with only one of both gives nothing."""
    rows = [("p:c1", "Caption", None, 3, 1), ("p:c2", "Caption", None, 5, 1), ("p:f1", "Figure", None, 4, 1), ("p:t", "Table", None, 4, None), ("p:c3", "Caption", "table", 1, None), ("p:c4", "Caption", None, 9, 2), ("p:f2", "Figure", None, 9, 3)]
    nodes = spark.createDataFrame([("p", *r) for r in rows], "paper_id string, node_id string, node_type string, caption_target string, source_index int, page int")
    edges = build.nearest_captions(nodes, spark.createDataFrame([], "src string, dst string"))
    assert "FlatMapGroups" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("p:c1", "p:f1"), ("p:c3", "p:t")]
