"""Reports, answers, places on pages, and the blocked product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ann, mapping, recall, reports


def test_reports(spark):
    nodes = spark.createDataFrame([("a", "p", "Sentence", "t", None), ("f", "p", "Figure", None, "f.png"), ("t", "q", "Table", "", "t.png"), ("u", "q", "Table", "x", "")], "node_id string, paper_id string, node_type string, text string, image_path string")
    assert tuple(reports.index_report(nodes, 8).first()) == (1, 1, 2, 8)
    got = {r.node_id: (r.how, r.text, r.image) for r in reports.embedding_inputs(nodes).collect()}
    assert got == {"a": ("text", "t", None), "f": ("image", None, "f.png"), "t": ("mixed", None, "t.png"), "u": ("mixed", "x", None)}
    edges = spark.createDataFrame([("a", "f", "refers_to")], "src string, dst string, relation string")
    samples = spark.createDataFrame([(None,), ("unmapped",), ("unmapped",)], "dropped string")
    rows = {r["name"]: r["value"] for r in reports.preparation_report(nodes, edges, samples).collect()}
    assert rows == {"papers": 2, "nodes.Sentence": 1, "nodes.Figure": 1, "nodes.Table": 2, "edges.refers_to": 1, "samples": 1, "dropped.unmapped": 2}
    listed = spark.createDataFrame([([1, 2], None, "x")], "a array<int>, b array<int>, c string")
    assert tuple(reports.summarised(listed).first()) == (2, 0, "x")
    runs = spark.createDataFrame([("d", "s", r, "m", v) for r, v in (("b", 2.0), ("a", 2.0), ("c", 1.0))], "dataset string, split string, run string, metric string, value double")
    best = reports.run_summary(runs).first()
    assert best.runs == 3 and best.best_runs == {"m": "a"}


def test_answers(spark):
    raw = [(1, '{"answer": "yes", "evidence_ids": ["n1", "n2", "n1", null]}'), (2, '```json\n{"answer": "no"}\n```'), (3, "plain words"), (4, None), (5, '{"evidence_ids": ["n1"]}')]
    got = {r.query_id: (r.answer, r.node_ids, r.valid) for r in reports.parsed_answers(spark.createDataFrame(raw, "query_id int, output string")).collect()}
    assert got == {1: ("yes", ["n1", "n2"], True), 2: ("no", [], True), 3: ("plain words", [], False), 4: ("", [], False), 5: ('{"evidence_ids": ["n1"]}', [], False)}
    answers = spark.createDataFrame([(1, ["a"]), (2, [])], "query_id int, node_ids array<string>")
    forest = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, node_id string")
    assert reports.checked_citations(answers, forest).count() == 2
    with pytest.raises(Exception):
        reports.checked_citations(answers, forest.where("query_id = 2")).collect()
    asked = spark.createDataFrame([(1, "who?")], "query_id int, query string")
    context = spark.createDataFrame([(1, "context", ["i.png"])], "query_id int, context string, image_paths array<string>")
    made = reports.answered(asked, context, lambda q, c, i: F.concat(F.lit('{"answer": "'), q, c, F.lit('", "evidence_ids": ["a"]}')))
    assert made.first().answer == "who?context"
    hits = spark.createDataFrame([(1, "a", 0.5, None)], "query_id int, node_id string, e double, g double")
    r = reports.score_components(hits, ["e", "g"], F.create_map(F.lit("g"), F.lit(2.0), F.lit("e"), F.lit(9.0))).select("components", reports.component("g").alias("g"), reports.component("x", -1.0).alias("x")).first()
    assert r.components == {"g": 2.0, "e": 0.5} and (r.g, r.x) == (2.0, -1.0)


def test_places(spark):
    words = [f"w{i}" for i in range(20)]
    page = [(w, float(i), 0.0, i + 1.0, 2.0 + i % 2) for i, w in enumerate(words)]
    pages = spark.createDataFrame([("p", 1, page), ("q", 1, [])], "paper_id string, page int, words array<struct<word:string,x0:double,y0:double,x1:double,y1:double>>")
    asked = [("a", "p", "w3 w4  w5"), ("b", "p", " ".join(["x", "y", "z", *words[5:17]])), ("c", "p", "w4 w3"), ("d", "q", "w1"), ("e", "p", ""), ("f", "p", " ".join(words) + " more")]
    got = {r.node_id: (r.how, r.bbox and tuple(r.bbox)) for r in reports.located(spark.createDataFrame([(n, p, 1, t) for n, p, t in asked], "node_id string, paper_id string, page int, text string"), pages).collect()}
    assert got == {"a": ("exact", (3.0, 0.0, 6.0, 3.0)), "b": ("part", (5.0, 0.0, 14.0, 3.0)), "c": (None, None), "d": (None, None), "e": (None, None), "f": ("part", (3.0, 0.0, 12.0, 3.0))}


def _vectors(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.4
    kinds = [recall.TYPES[i % 3] for i in range(n)]
    return x, kinds, spark.createDataFrame([(str(i), f"p{i % 7}", kinds[i], [float(v) for v in x[i]], i) for i in range(n)], "node_id string, paper_id string, node_type string, vector array<float>, ord int")


def test_blocked_product_equals_plain_one(spark, monkeypatch):
    x, kinds, v = _vectors(spark, 300)
    asked = v.where("ord % 20 = 0").select(F.col("ord").alias("query_id"), F.col("vector").alias("query_vector"))
    unit = (y := x.astype(np.float32).astype(float)) / np.linalg.norm(y, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 20):
        s = np.round(unit @ unit[q], 9)
        for k in set(kinds):
            own = [i for i in range(300) if kinds[i] == k]
            want |= {(q, str(i)) for i in sorted(own, key=lambda i: (-s[i], i))[:5]}
    for rows, queries in ((65_536, 2_048), (70, 4)):
        monkeypatch.setattr(recall, "BLOCK_ROWS", rows)
        monkeypatch.setattr(recall, "BLOCK_QUERIES", queries)
        found = recall.cosine(asked, v, 5)
        assert {(r.query_id, r.node_id) for r in found.collect()} == want
    assert "Cartesian" not in found._jdf.queryExecution().toString() and recall.cosine(asked.where("false"), v).count() == 0


def test_inverted_lists_find_most(spark):
    _, _, v = _vectors(spark, 1500, 3)
    asked = v.where("ord % 50 = 0").select(F.col("ord").alias("query_id"), F.col("vector").alias("query_vector"))
    index = ann.fit(v, lists=16, sample=600)
    exact = {(r.query_id, r.node_id) for r in recall.cosine(asked, v, 10).collect()}
    near = {(r.query_id, r.node_id) for r in ann.search(asked, ann.assigned(v, index), index, 10, probes=5).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    everything = {(r.query_id, r.node_id) for r in ann.search(asked, ann.assigned(v, index), index, 10, probes=16).collect()}
    assert everything == exact


def test_jaccard_of_pairs_that_share_words(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["q"])], "evidence_id int, words array<string>")
    b = spark.createDataFrame([("n", ["y", "z"]), ("m", ["w"])], "node_id string, words array<string>")
    assert [tuple(r) for r in mapping.jaccard(a, b).collect()] == [(1, "n", 1 / 3)]
