"""Reading and writing graphs, samples, layout blocks, vectors, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
_NODE = "struct<node_id:string,paper_id:string,node_type:string,text:string,image_path:string,page:int,bbox:array<double>,parser_block_id:string,confidence:double,provenance:string,attributes:string>"
_EDGE = "struct<src:string,dst:string,relation:string,confidence:double,mandatory_for_closure:boolean,directional:boolean,attributes:string>"
_SAMPLE = (
    "query_id string, query string, question string, answer string, answer_type string, entity_type string, metric string, operator string, value double, unit string, conditions array<string>,"
    " required_modalities array<string>, paper_id string, paper_ids array<string>, candidate_node_ids array<string>, relevant_node_ids array<string>"
)


def read_graph(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files, one document a file or (lines) one a line; another schema version is an error.

    Defaults: confidence 1, not mandatory, directional. A text missing from anything but a figure is the empty string.
    text_view, entities and source_index are taken out of the attributes.
    """
    raw = spark.read.option("multiLine", not lines).schema(f"schema_version string, nodes array<{_NODE}>, edges array<{_EDGE}>").json(path)
    fits = F.when(F.col("schema_version").eqNullSafe(VERSION), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported graph schema: "), F.coalesce("schema_version", F.lit("none")))))
    raw = raw.where(fits)
    n = raw.select(F.explode("nodes").alias("n")).select("n.*")
    attr = lambda k: F.get_json_object("attributes", f"$.{k}")
    nodes = n.select(
        "node_id", "paper_id", "node_type",
        F.when(F.col("node_type") == "Figure", F.col("text")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        "image_path", "page",
        F.when(F.size("bbox") == 4, F.struct(F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0"), F.col("bbox")[2].alias("x1"), F.col("bbox")[3].alias("y1"))).alias("bbox"),
        "parser_block_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "provenance", "attributes",
        attr("text_view").alias("text_view"), F.from_json(attr("entities"), "array<string>").alias("entities"), attr("source_index").cast("int").alias("source_index"),
    )
    e = raw.select(F.explode("edges").alias("e")).select("e.*")
    edges = e.select("src", "dst", "relation", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("mandatory_for_closure", F.lit(False)).alias("mandatory_for_closure"), F.coalesce("directional", F.lit(True)).alias("directional"), "attributes")
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables, nodes by type, which is how recall reads them."""
    nodes.write.partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Documents of the graph format as JSON lines, one for each paper's nodes and the edges out of them; read_graph(lines=True) reads them back.

    text_view, entities and source_index go into the attributes; letters stay as they are.
    """
    have = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    own = F.create_map(*[x for c in ("text_view", "entities", "source_index") for x in (F.lit(c), F.to_json(F.struct(have(nodes, c).alias("v"))))])
    given = F.from_json(F.coalesce(have(nodes, "attributes").cast("string"), F.lit("{}")), "map<string,variant>")
    fresh = F.transform_values(F.map_filter(own, lambda k, v: v != "{}"), lambda k, v: F.variant_get(F.parse_json(v), "$.v", "variant"))
    attributes = F.map_concat(F.map_filter(given, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    box = F.when(F.col("bbox").isNotNull(), F.array(*[F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1")])) if "bbox" in nodes.columns else F.lit(None)
    plain = ("node_id", "paper_id", "node_type", "text", "image_path", "page", "parser_block_id", "confidence")
    node = F.struct(*[have(nodes, c).alias(c) for c in plain], box.alias("bbox"), F.try_parse_json(have(nodes, "provenance").cast("string")).alias("provenance"), attributes.alias("attributes"))
    by_paper = nodes.groupBy("paper_id").agg(F.collect_list(node).alias("nodes"))
    plain = ("src", "dst", "relation", "confidence", "mandatory_for_closure", "directional")
    edge = F.struct(*[have(edges, c).alias(c) for c in plain], F.try_parse_json(have(edges, "attributes").cast("string")).alias("attributes"))
    placed = edges.join(nodes.select(F.col("node_id").alias("src"), F.col("paper_id").alias("__paper")), "src", "left")
    out = by_paper.join(placed.groupBy(F.col("__paper").alias("paper_id")).agg(F.collect_list(edge).alias("edges")), "paper_id", "full")
    out.select(F.lit(VERSION).alias("schema_version"), F.coalesce("nodes", F.array()).alias("nodes"), F.coalesce("edges", F.array()).alias("edges")).write.json(path)


def read_samples(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """Evaluation samples: query (or question), scope lists with paper_id merged in, gold (an empty one is an error).

    A missing query_id is the row's hash. With nodes, gold and candidates outside the graph, and gold outside given candidates, are errors.
    """
    raw = spark.read.schema(_SAMPLE).json(path)
    none = F.array().cast("array<string>")
    s = raw.select(
        F.coalesce("query_id", F.sha1(F.to_json(F.struct(*raw.columns)))).alias("query_id"),
        F.coalesce("query", "question").alias("query"), "answer", "answer_type", "entity_type", "metric", "operator", "value", "unit",
        F.coalesce("conditions", none).alias("conditions"), F.coalesce("required_modalities", none).alias("required_modalities"),
        F.array_distinct(F.concat(F.coalesce("paper_ids", none), F.array_compact(F.array("paper_id")))).alias("paper_ids"),
        F.coalesce("candidate_node_ids", none).alias("candidate_node_ids"), F.coalesce("relevant_node_ids", none).alias("relevant_node_ids"),
    )
    outside = F.array_except("relevant_node_ids", "candidate_node_ids")
    bad = F.when(F.size("relevant_node_ids") == 0, F.lit("no gold")).when((F.size("candidate_node_ids") > 0) & (F.size(outside) > 0), F.lit("gold outside the candidates"))
    s = s.where(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.col("query_id")))).otherwise(F.lit(True)))
    if nodes is None:
        return s
    named = s.select("query_id", F.explode(F.concat("relevant_node_ids", "candidate_node_ids")).alias("node_id"))
    lost = named.join(nodes.select("node_id"), "node_id", "left_anti").groupBy("query_id").agg(F.first("node_id").alias("__lost"))
    checked = s.join(lost, "query_id", "left")
    return checked.where(F.when(F.col("__lost").isNotNull(), F.raise_error(F.concat(F.lit("unknown node "), F.col("__lost")))).otherwise(F.lit(True))).drop("__lost")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Layout blocks (paper_id, index, block) of block-list files, or of the first list under content_list, blocks, items or content; the paper is the file's stem without _content_list."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"), F.input_file_name().alias("f"))
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(F.url_decode("f"), "/", -1), r"\.[^.]*$", ""), "_content_list$", "")
    found = F.when(F.ltrim("v").startswith("["), F.col("v")).otherwise(F.coalesce(*[F.when(F.ltrim(F.get_json_object("v", f"$.{k}")).startswith("["), F.get_json_object("v", f"$.{k}")) for k in ("content_list", "blocks", "items", "content")]))
    listed = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no block list in "), F.col("f")))).otherwise(found)
    # blocks differ in their fields, so each stays a JSON text
    rows = files.select(stem.alias("paper_id"), F.from_json(listed, "array<string>").alias("b"))
    return rows.select("paper_id", F.posexplode("b").alias("index", "block"))


def read_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_vectors(vectors: DataFrame, nodes: DataFrame, path: str, model: str) -> None:
    """node_id and vector as Parquet, beside one row of what they were made from: digests of the graph and the model's name and dimension."""
    vectors.select("node_id", "vector").write.parquet(f"{path}/vectors")
    digest = nodes.agg(F.bit_xor(F.xxhash64(*[c for c in ("node_id", "text", "image_path") if c in nodes.columns])).alias("graph"), F.count("*").alias("n"))
    digest.withColumn("model", F.lit(model)).crossJoin(vectors.select(F.size("vector").alias("dimension")).limit(1)).write.json(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Vectors of a graph; ids that differ from the graph's, or unequal dimensions, are errors."""
    v = spark.read.parquet(f"{path}/vectors")
    ids = nodes.select("node_id")
    odd = v.join(ids, "node_id", "left_anti").limit(1).count() + ids.join(v, "node_id", "left_anti").limit(1).count()
    if odd or v.select(F.size("vector")).distinct().limit(2).count() > 1:
        raise ValueError("vectors do not belong to this graph")
    return v


def new_files(spark: SparkSession, path: str, done: DataFrame, pattern: str = "*.pdf") -> DataFrame:
    """Files below path (path, stem) whose stem is not among done (stem)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    return files.withColumn("stem", F.regexp_replace(F.substring_index(F.url_decode("path"), "/", -1), r"\.[^.]*$", "")).join(done.select("stem"), "stem", "left_anti")


def image_kind(content) -> F.Column:
    """png, jpg, gif, webp, bmp or tiff by a file's first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("424D"), "bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
    )


def valid_download(content, suffix: str) -> F.Column:
    """Whether a file begins as its suffix says: zip, pdf, json or jsonl; others need only be there."""
    head, text = F.hex(F.substring(content, 1, 4)), F.ltrim(F.decode(F.substring(content, 1, 64), "UTF-8"))
    if suffix == "zip":
        return head.isin("504B0304", "504B0506", "504B0708")
    if suffix == "pdf":
        return head == "25504446"
    if suffix in ("json", "jsonl"):
        return text.startswith("{") | text.startswith("[")
    return F.length(content) > 0


def write_comparison(table: DataFrame, path: str) -> None:
    """A comparison (one row a run, in the order of its first column) as CSV with a byte order mark that spreadsheets look for, and as a Markdown table."""
    columns, spark = table.columns, table.sparkSession
    quote = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    cells = F.array_join(F.array(*[quote(text(c)) for c in columns]), ",")
    shown = F.concat(F.lit("| "), F.array_join(F.array(*[F.when(number(c).isNotNull(), F.format_string("%.4f", number(c))).otherwise(text(c)) for c in columns]), " | "), F.lit(" |"))
    titles = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in columns)
    for name, heads, body in (("csv", ["\ufeff" + titles], cells), ("markdown", [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"], shown)):
        top = spark.createDataFrame([(i, "", h) for i, h in enumerate(heads)], "part int, name string, value string")
        rows = table.select(F.lit(len(heads)).alias("part"), text(columns[0]).alias("name"), body.alias("value"))
        top.unionByName(rows).repartition(1).sortWithinPartitions("part", "name").select("value").write.text(f"{path}/{name}")


COLLECTION = "node_id string, vector array<float>, paper_id string, page int, point_id string, node_type string"


def ensure_collection(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """The points of the vector collection at path, which is made if it is not there; one of another dimension is an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], COLLECTION).write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/points")
        spark.createDataFrame([(dimension, "cosine")], "dimension int, distance string").write.json(f"{path}/meta")
    found = spark.read.schema("dimension int, distance string").json(f"{path}/meta").first()
    if found["dimension"] != dimension:
        raise ValueError(f"the collection has dimension {found['dimension']}")
    return spark.read.schema(COLLECTION).parquet(f"{path}/points")


def upsert_nodes(vectors: DataFrame, nodes: DataFrame, path: str, dimension: int) -> None:
    """Points of vectors (node_id, vector) into a collection: new ones join, those of known ids are replaced, all others stay.

    A point's id comes from its node's; beside it is what searches filter by. Node types without new points are not touched; a type is
    written anew from a written union, so a lost executor loses nothing.
    """
    from ..functions.text import uuid5_of
    from .scratch import Scratch

    spark = nodes.sparkSession
    names = [x.split(" ")[0] for x in COLLECTION.split(", ")]
    old, written = ensure_collection(spark, path, dimension), Scratch(spark, "points")
    new = vectors.select("node_id", F.col("vector").cast("array<float>").alias("vector")).join(nodes.select("node_id", "paper_id", "node_type", F.col("page").cast("int").alias("page")), "node_id").withColumn("point_id", uuid5_of(F.col("node_id")))
    sized = F.when(F.size("vector") == dimension, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("vector of another dimension: "), F.col("node_id"))))
    new = written.write(new.where(sized).select(*names))
    # a node whose type has changed leaves its old type, so that type is written too
    moved = old.join(new.select("point_id", F.col("node_type").alias("__t")), "point_id").where("node_type <> __t").select("node_type")
    touched = new.select("node_type").unionByName(moved).distinct()
    kept = old.join(touched, "node_type", "left_semi").join(new, "point_id", "left_anti").select(*names)
    merged = written.write(kept.unionByName(new))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("node_type").parquet(f"{path}/points")


def export_node_vectors(vectors: DataFrame, nodes: DataFrame, path: str, **training) -> None:
    """Graph-model vectors (node_id, graph_vector) of all nodes as Parquet, beside one row of how they were trained and their dimension."""
    dimension = vectors.select(F.size("graph_vector").alias("d")).agg(F.max("d").alias("dimension"), F.min("d").alias("least"), F.count("*").alias("n"))
    dimension.withColumn("training", F.lit(json.dumps(training, sort_keys=True))).write.json(f"{path}/meta")
    vectors.join(nodes.select("node_id"), "node_id", "left_semi").select("node_id", "graph_vector").write.parquet(f"{path}/vectors")


def read_node_vectors(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """What export_node_vectors wrote; unequal dimensions, or others than given, are errors."""
    meta = spark.read.schema("dimension int, least int, n long, training string").json(f"{path}/meta").first()
    if meta["dimension"] != meta["least"] or (dimension is not None and dimension != meta["dimension"]):
        raise ValueError(f"vectors of dimension {meta['dimension']}")
    return spark.read.schema("node_id string, graph_vector array<float>").parquet(f"{path}/vectors")
