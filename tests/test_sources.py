"""Readers, writers, dataset converters, layout blocks, streams and systems."""

import json

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import build
from lumenfold.plans import registry, systems
from lumenfold.sources import datasets, graphs
from lumenfold.streaming import ingest


def test_graph_files(spark, tmp_path):
    doc = {"schema_version": "1.0", "nodes": [{"node_id": "p:s", "paper_id": "p", "node_type": "Sentence"}, {"node_id": "p:f", "paper_id": "p", "node_type": "Figure", "image_path": "f.png", "bbox": [0, 1, 2, 3], "attributes": {"text_view": "vü", "entities": ["e"], "source_index": 4}}], "edges": [{"src": "p:s", "dst": "p:f", "relation": "refers_to"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    nodes, edges = graphs.read_graph(spark, str(tmp_path / "g.json"))
    got = {r.node_id: r for r in nodes.collect()}
    assert got["p:s"].text == "" and got["p:s"].confidence == 1.0 and got["p:f"].text is None and got["p:f"].text_view == "vü" and got["p:f"].entities == ["e"] and got["p:f"].bbox.y1 == 3
    e = edges.first()
    assert (e.confidence, e.mandatory_for_closure, e.directional) == (1.0, False, True)
    graphs.write_graph(nodes.drop("entities"), edges, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 2
    graphs.export_graph(nodes.where("node_id <> 'p:s'").unionByName(nodes.where("node_id = 'p:s'")), edges, str(tmp_path / "json"))
    assert '"text_view":"vü"' in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    again = graphs.read_graph(spark, str(tmp_path / "json"), lines=True)
    for a, b in zip((nodes, edges), again):
        assert sorted(map(repr, a.drop("attributes").collect())) == sorted(map(repr, b.drop("attributes").collect()))
    (tmp_path / "old.json").write_text(json.dumps({**doc, "schema_version": "0.9"}))
    with pytest.raises(Exception):
        graphs.read_graph(spark, str(tmp_path / "old.json"))[0].collect()


def test_samples(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text(json.dumps({"query_id": "q", "query": "x", "paper_id": "p", "paper_ids": ["r", "p"], "relevant_node_ids": ["n"]}) + "\n\n")
    nodes = spark.createDataFrame([("n",)], "node_id string")
    s = graphs.read_samples(spark, str(path), nodes).first()
    assert s.paper_ids == ["r", "p"] and s.candidate_node_ids == []
    with pytest.raises(Exception):
        graphs.read_samples(spark, str(path), nodes.where("false")).collect()
    path.write_text(json.dumps({"query": "x", "relevant_node_ids": []}))
    with pytest.raises(Exception):
        graphs.read_samples(spark, str(path)).collect()


def test_blocks_and_vectors(spark, tmp_path):
    (tmp_path / "paper_content_list.json").write_text(json.dumps([{"type": "text", "text": "One sentence here."}, {"type": "image"}]))
    (tmp_path / "other.json").write_text(json.dumps({"blocks": [{"type": "text", "text": "Elsewhere."}]}))
    b = graphs.read_blocks(spark, str(tmp_path))
    assert sorted((r.paper_id, r["index"]) for r in b.collect()) == [("other", 0), ("paper", 0), ("paper", 1)]
    nodes, _, warnings = build.blocks_to_graph(b)
    assert {r.text for r in nodes.collect()} == {"One sentence here.", "Elsewhere."} and warnings.count() == 1
    n = spark.createDataFrame([("a", "p", "Sentence", 1)], "node_id string, paper_id string, node_type string, page int")
    v = spark.createDataFrame([("a", [1.0, 2.0])], "node_id string, vector array<float>")
    graphs.write_vectors(v, n, str(tmp_path / "v"), "m")
    assert graphs.read_vectors(spark, str(tmp_path / "v"), n).count() == 1
    with pytest.raises(ValueError):
        graphs.read_vectors(spark, str(tmp_path / "v"), n.where("false"))
    up = str(tmp_path / "up")
    more = spark.createDataFrame([("a", "p", "Sentence", 1), ("b", "p", "Sentence", 2), ("f", "q", "Figure", 3)], "node_id string, paper_id string, node_type string, page int")
    vector = lambda *rows: spark.createDataFrame(list(rows), "node_id string, vector array<float>")
    points = lambda: {r.node_id: (r.vector, r.node_type) for r in graphs.ensure_collection(spark, up, 2).collect()}
    assert points() == {}
    graphs.upsert_nodes(vector(("a", [1.0, 2.0]), ("f", [0.0, 1.0])), more, up, 2)
    graphs.upsert_nodes(vector(("a", [3.0, 4.0]), ("b", [5.0, 6.0])), more, up, 2)
    assert points() == {"a": ([3.0, 4.0], "Sentence"), "b": ([5.0, 6.0], "Sentence"), "f": ([0.0, 1.0], "Figure")}
    graphs.upsert_nodes(vector(("b", [7.0, 8.0])), more.withColumn("node_type", F.lit("Caption")), up, 2)
    assert points() == {"a": ([3.0, 4.0], "Sentence"), "b": ([7.0, 8.0], "Caption"), "f": ([0.0, 1.0], "Figure")}
    assert graphs.ensure_collection(spark, up, 2).first().point_id.count("-") == 4
    with pytest.raises(ValueError):
        graphs.ensure_collection(spark, up, 3)
    with pytest.raises(Exception):
        graphs.upsert_nodes(vector(("a", [1.0])), more, up, 2)
    graphs.export_node_vectors(vector(("a", [1.0, 2.0])).withColumnRenamed("vector", "graph_vector"), more, str(tmp_path / "hgt"), epochs=3)
    assert graphs.read_node_vectors(spark, str(tmp_path / "hgt"), 2).first().graph_vector == [1.0, 2.0]
    with pytest.raises(ValueError):
        graphs.read_node_vectors(spark, str(tmp_path / "hgt"), 3)


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1")
    done = spark.createDataFrame([("a",)], "stem string")
    assert [r.stem for r in graphs.new_files(spark, str(tmp_path), done).collect()] == ["b"]
    rows = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n0000",), (b"\xff\xd8\xff\xe0",), (b"RIFF0000WEBP",), (b"oops",)], "c binary")
    assert [r.k for r in rows.select(graphs.image_kind(F.col("c")).alias("k")).collect()] == ["png", "jpg", "webp", None]
    t = spark.createDataFrame([("r1", 0.5, "x"), ("r2", None, "y")], "run string, m double, n string")
    graphs.write_comparison(t, str(tmp_path / "cmp"))
    text = next((tmp_path / "cmp/csv").glob("*.txt")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfrun,m,n\n") and b"r1,0.5,x" in text
    assert "| r1 | 0.5000 | x |" in "".join(p.read_text() for p in (tmp_path / "cmp/markdown").glob("*.txt"))


def test_peer(spark):
    rows = spark.createDataFrame([("p", 1, "sentence", "Second sentence."), ("p", 0, "sentence", "First sentence."), ("p", 2, "figure_caption", "A caption.")], "paper_id string, idx int, type string, content string")
    nodes, edges = datasets.peer_graph(rows)
    assert {r.node_id: r.node_type for r in nodes.collect()} == {"peerqa::p::0": "Sentence", "peerqa::p::1": "Sentence", "peerqa::p::2": "Caption"} and edges.count() == 2
    qa = spark.createDataFrame([("a", "p", "?", True, [([0, 9],), ([2],)], ["x"], "y"), ("b", "p", "?", True, [([9],)], ["first  SENTENCE", "Second sentence"], "y"), ("c", "p", "?", True, [], ["unrelated words"], None), ("d", "p", "?", False, [([0],)], [], "y")], "question_id string, paper_id string, question string, answerable boolean, answer_evidence_mapped array<struct<idx:array<int>>>, answer_evidence_sent array<string>, answer_free_form string")
    got = {r.query_id: (r.relevant_node_ids, r.dropped) for r in datasets.peer_samples(qa, nodes).collect()}
    assert got == {"a": (["peerqa::p::0", "peerqa::p::2"], None), "b": (["peerqa::p::0", "peerqa::p::1"], None), "c": ([], "unmapped"), "d": (["peerqa::p::0"], "unanswerable")}


def test_quotes(spark):
    schema = "split string, q_id int, doc_name string, question string, text_quotes array<struct<quote_id:string,text:string,page_id:int>>, img_quotes array<struct<quote_id:string,img_path:string,img_description:string,page_id:int>>, gold_quotes array<string>, answer_short string"
    row = (7, "doc", "?", [("t1", "one", 1), ("t1", "two", 1)], [("i1", "dir/a.png", "view", 2)], ["i1", "t1"], "yes")
    rows = spark.createDataFrame([("dev", *row), ("test", *row)], schema)
    nodes, samples = datasets.quote_graph(rows, spark.createDataFrame([("other/a.png", "/abs/a.png")], "name string, path string"))
    got = {r.node_id: r for r in nodes.collect()}
    assert len(got) == 4 and got["mmdocrag::dev::doc::text:q7:t1"].text == "one" and got["mmdocrag::test::doc::image:q7:i1"].image_path == "/abs/a.png"
    s = {r.query_id: r for r in samples.collect()}["mmdocrag::dev::7"]
    assert s.relevant_node_ids == ["mmdocrag::dev::doc::image:q7:i1", "mmdocrag::dev::doc::text:q7:t1"] and len(s.candidate_node_ids) == 2


def test_components(spark):
    doc = {"text": {"t": {"text": "A passage."}, "e": {"text": ""}}, "table": {"tb": {"table": [["Head", {"ref": "r1"}], [{"text": "v  1"}, ""]], "refs": {"r1": {"text": "Solved", "image": {"filename": "x/c.png"}}}}}, "image": {"im": {"filename": "a.png", "caption": {"text": "Seen  here"}}, "gone": {"filename": "z.png"}}}
    docs = spark.createDataFrame([("Title", json.dumps(doc))], "title string, doc string")
    nodes, edges = datasets.component_graph(docs, spark.createDataFrame([("a.png", "/i/a.png"), ("d/c.png", "/i/c.png")], "name string, path string"))
    got = {r.node_type: r for r in nodes.collect()}
    assert nodes.count() == 4 and got["Table"].text == "Head\tSolved\nv 1" and got["Table"].image_path == "/i/c.png"
    assert got["Caption"].text == "Seen here" and got["Figure"].text_view == "Seen here" and edges.count() == 1
    index = spark.createDataFrame([("A", "1", "n1"), ("B", "2", "n2"), ("C", "2", "n3"), ("D", "4", "n4")], "title string, component_id string, node_id string")
    ev = "array<struct<mmqa_doc_modality:string,gold_webpage_title:string,gold_component_id:string>>"
    qa = spark.createDataFrame([(1, "?", "a", [("text", "A", "1"), ("table", "?", "4")]), (2, "?", "a", [("text", "?", "2")])], f"qid int, question string, answer string, evidences {ev}")
    s = datasets.component_samples(qa, index).collect()
    assert len(s) == 1 and s[0].relevant_node_ids == ["n1", "n4"] and s[0].required_modalities == ["text", "table"]


def test_pages(spark):
    pages = spark.createDataFrame([("d.pdf", i, f"/x/d_{i}.png") for i in (1, 2, 3)], "doc_id string, page int, image_path string")
    nodes = datasets.page_nodes(pages, "mmlongbench_doc")
    rows = spark.createDataFrame([(0, "d.pdf", "?", "a", "[1, 2]", "['Table', 'Chart']"), (1, "d.pdf", "?", "a", "[]", "[]"), (2, "d.pdf", "?", "a", "[9]", "[]")], "row int, doc_id string, question string, answer string, evidence_pages string, evidence_sources string")
    s = datasets.page_samples(rows, nodes).collect()
    assert len(s) == 1 and len(s[0].relevant_node_ids) == 2 and len(s[0].candidate_node_ids) == 3 and s[0].required_modalities == ["table", "figure"]
    qa = spark.createDataFrame([(1, "?", "a", [("y/d_2.png", "image"), ("d_3", None)]), (2, "?", "a", [("zz", None)])], "qid int, question string, answer string, evidences array<struct<gold_page:string,mmqa_doc_modality:string>>")
    m = datasets.named_page_samples(qa, nodes).collect()
    assert len(m) == 1 and len(m[0].relevant_node_ids) == 2 and m[0].required_modalities == ["image"]
    split = datasets.with_split(spark.createDataFrame([(f"p{i % 5}", i) for i in range(15)], "paper_id string, i int"), "paper_id")
    assert split.groupBy("paper_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    datasets.check_preparation({"missing_images": []})
    with pytest.raises(ValueError):
        datasets.check_preparation({"missing_images": ["x"]})
    q = spark.createDataFrame([("a",)], "query_id string")
    with pytest.raises(ValueError):
        datasets.check_leakage(q, q)


def test_scanned_pages(spark, tmp_path):
    for doc, name in (("d1", "page_10.png"), ("d1", "page_2.png"), ("d 2", "x.png")):
        (tmp_path / doc).mkdir(exist_ok=True)
        (tmp_path / doc / name).write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "d1/page_3.png").write_bytes(b"oops")
    pages, bad = datasets.scanned_pages(spark, str(tmp_path))
    assert sorted((r.doc_id, r.page, r.image_path.rsplit("/", 1)[1]) for r in pages.collect()) == [("d 2", 1, "x.png"), ("d1", 1, "page_2.png"), ("d1", 2, "page_10.png")]
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["page_3.png"]
    assert datasets.page_nodes(pages, "m").count() == 3


def test_leakage(spark):
    q = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_id string")
    nodes = spark.createDataFrame([("a", "t"), ("b", None)], "node_id string, text string")
    edges = spark.createDataFrame([("a", "b", "refers_to")], "src string, dst string, relation string")
    digest = datasets.graph_digest(nodes, edges)
    assert digest == datasets.graph_digest(nodes.repartition(3), edges) != datasets.graph_digest(nodes.where("node_id = 'a'"), edges)
    datasets.check_leakage(q("a"), q("b"), digest, digest)
    with pytest.raises(ValueError):
        datasets.check_leakage(q("a"), q("a", "b"))
    with pytest.raises(ValueError):
        datasets.check_leakage(q("a"), q("b"), "other", digest)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"paper_id": "p", "index": i, "block": json.dumps({"type": t, "text": x}), "at": f"2024-01-01T00:0{i}:00Z"} for i, (t, x) in enumerate((("text", "First sentence. Second sentence."), ("caption", "Figure 1. Curve")))]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    blocks = ingest.block_stream(spark, str(tmp_path / "in"))
    q = ingest.streamed_nodes(blocks).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("streamed").count() == 3
    c = ingest.windowed_counts(blocks).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    c.awaitTermination(60)
    assert {r.kind: r["count"] for r in spark.table("counted").collect()} == {"text": 1, "caption": 1}
    w = ingest.write_linked(blocks, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 3


def test_systems(spark):
    nodes = spark.createDataFrame([(f"p:{i}", "p", "Sentence", f"word{i} common", None) for i in range(4)], "node_id string, paper_id string, node_type string, text string, image_path string")
    edges = spark.createDataFrame([("p:0", "p:1", "next_sentence", 1.0)], "src string, dst string, relation string, confidence double")
    v = spark.createDataFrame([(f"p:{i}", "p", "Sentence", [1.0, float(i)], i) for i in range(4)], "node_id string, paper_id string, node_type string, vector array<double>, ord int")
    q = spark.createDataFrame([(1, "word2", [1.0, 0.0])], "query_id int, query string, query_vector array<double>")
    first = lambda name, **m: systems.ranked_hits(systems.SYSTEMS[name], q, nodes, v, **m).orderBy("pos").first().node_id
    assert first("bm25") == "p:2" and first("dense") == "p:0"
    best = lambda query, document: F.when(document["text"].startswith(query), 9.0).otherwise(0.0)
    hits = systems.ranked_hits(systems.SYSTEMS["dense_reranker"], q, nodes, v, reranker=best)
    assert {r.node_id: r.pos for r in hits.collect()}["p:2"] <= 2
    scored = lambda h: systems.graph_scored(h, q.selectExpr("query_id", "query_vector AS projected"), v.selectExpr("node_id", "vector AS graph_vector").where("node_id <> 'p:3'"))
    assert systems.ranked_hits(systems.SYSTEMS["full"], q, nodes, v, graph_scorer=scored).count() == 4
    gold = spark.createDataFrame([(1, "p:0")], "query_id int, node_id string")
    report = {r.metric: r.value for r in systems.benchmark({"one_hop": systems.SYSTEMS["one_hop"]}, q, gold, nodes, edges, v, systems.Setting(top_k=1)).collect()}
    assert report["macro_recall_at_1"] == 1 and report["macro_selected_nodes"] == 2 and report["macro_closure_validity"] == 1
    for bad in (lambda: systems.ranked_hits(systems.SYSTEMS["dense"], q, nodes), lambda: systems.ranked_hits(systems.SYSTEMS["full"], q, nodes, v)):
        with pytest.raises(ValueError):
            bad()
    assert systems.batch_consistency(q, q.withColumn("query_vector", F.array(F.lit(0.0), F.lit(1.0)))).count() == 1


def same(spark_rows, duck_rows):
    return sorted(map(repr, spark_rows)) == sorted(map(repr, duck_rows))


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = registry.QUERIES[name](spark, data)
    r = c.sql(registry.ORACLES[name])
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    assert sorted(df.columns) == sorted(r.columns)
    assert same([plain(tuple(x)) for x in df.select(*sorted(df.columns)).collect()], [plain(tuple(x[i] for i in order)) for x in r.fetchall()])
