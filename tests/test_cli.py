"""Commands end to end on small files."""

import json

import pytest

from lumenfold import cli, config


def test_blocks_to_benchmark(spark, tmp_path):
    blocks = [{"type": "text", "text": "As shown in Fig. 1, river depth grows.", "page_idx": 0}, {"type": "image", "img_path": "f.png", "img_caption": ["Figure 1. Depth"], "page_idx": 0}, {"type": "image"}]
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks/paper.json").write_text(json.dumps(blocks))
    cli.main(["build-graph", str(tmp_path / "blocks"), str(tmp_path / "g"), "--base", "/img"])
    cli.main(["inspect-graph", str(tmp_path / "g")])
    cli.main(["list-figures", str(tmp_path / "g"), str(tmp_path / "figures")])
    assert spark.read.json(str(tmp_path / "figures")).first().image_path == "/img/f.png"
    (tmp_path / "charts.jsonl").write_text(json.dumps({"figure_id": "paper:figure:1", "linearized_table": "a,b\n1,2"}))
    cli.main(["enrich-charts", str(tmp_path / "g"), str(tmp_path / "charts.jsonl"), str(tmp_path / "g2")])
    nodes = {r.node_id: r for r in spark.read.parquet(str(tmp_path / "g2/nodes")).collect()}
    assert nodes["paper:chart_data:1"].node_type == "ChartData"
    assert nodes["paper:figure:1"].text_view == "Figure 1. Depth\na,b\n1,2\nAs shown in Fig. 1, river depth grows."
    cli.main(["merge-graphs", str(tmp_path / "g"), str(tmp_path / "g"), "--out", str(tmp_path / "m")])
    assert spark.read.parquet(str(tmp_path / "m/nodes")).count() == 3
    (tmp_path / "s.jsonl").write_text(json.dumps({"query_id": "q", "query": "river depth", "relevant_node_ids": ["paper:sentence:0:0"]}))
    cli.main(["benchmark", str(tmp_path / "g2"), str(tmp_path / "s.jsonl"), str(tmp_path / "b"), "--systems", "bm25"])
    assert spark.read.json(str(tmp_path / "b/report")).where("metric = 'macro_recall_at_3'").first().value == 1.0


def test_index_mapping_and_report(spark, tmp_path):
    from lumenfold.sources import graphs

    nodes = spark.createDataFrame([("a", "p", "Sentence", "The river is deep.", None), ("f", "p", "Figure", None, "f.png")], "node_id string, paper_id string, node_type string, text string, image_path string")
    edges = spark.createDataFrame([("a", "f", "refers_to", 1.0)], "src string, dst string, relation string, confidence double")
    graphs.write_graph(nodes, edges, str(tmp_path / "g"))
    graphs.write_vectors(spark.createDataFrame([("a", [1.0, 0.0]), ("f", [0.0, 1.0])], "node_id string, vector array<float>"), nodes, str(tmp_path / "v"), "m")
    cli.main(["index", str(tmp_path / "g"), str(tmp_path / "v"), str(tmp_path / "i")])
    assert spark.read.json(str(tmp_path / "i/report")).first().text_nodes == 1 and graphs.ensure_collection(spark, str(tmp_path / "i"), 2).count() == 2
    (tmp_path / "e.jsonl").write_text(json.dumps({"evidence_id": "x", "paper_id": "p", "evidence": "the RIVER is deep"}))
    cli.main(["map-evidence", str(tmp_path / "g"), str(tmp_path / "e.jsonl"), str(tmp_path / "m")])
    assert spark.read.json(str(tmp_path / "m")).first().node_id == "a"
    (tmp_path / "s.jsonl").write_text(json.dumps({"query_id": "q"}) + "\n" + json.dumps({"query_id": "r", "dropped": "unmapped"}))
    cli.main(["report-preparation", str(tmp_path / "g"), str(tmp_path / "s.jsonl"), str(tmp_path / "r")])
    assert {r["name"]: r["value"] for r in spark.read.json(str(tmp_path / "r")).collect()}["dropped.unmapped"] == 1


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"embedding": {"dimension": 2048}, "retrieval": {"budget": 99, "relation_costs": {"contains": 1}}}))
    c = config.load(str(path))
    config.check(c)
    assert config.setting_of(c).budget == 99 and config.relation_costs(c)["contains"] == 1.0
    with pytest.raises(ValueError):
        config.check({"embedding": {"dimension": 3}})
    path.write_text("[]")
    with pytest.raises(ValueError):
        config.load(str(path))
