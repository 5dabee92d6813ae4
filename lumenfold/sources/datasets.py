"""Converters of published question-answering sets to nodes, edges and samples. Inputs are DataFrames of the sets' own rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, grouped_split, safe_name
from ..operators.mapping import map_evidence
from .graphs import image_kind


def peer_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (paper_id, idx, type, content) -> sentences and captions, neighbours by idx."""
    kind = F.when(F.lower(F.coalesce("type", F.lit("sentence"))).contains("caption"), "Caption").otherwise("Sentence")
    nodes = rows.select(F.concat(F.lit("peerqa::"), "paper_id", F.lit("::"), F.col("idx").cast("string")).alias("node_id"), "paper_id", kind.alias("node_type"), F.coalesce("content", F.lit("")).alias("text"), F.col("idx").alias("ord"))
    nxt = F.lead("node_id").over(Window.partitionBy("paper_id").orderBy("ord", "node_id"))
    edges = nodes.select(F.col("node_id").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL").withColumns({"relation": F.lit("next_sentence"), "confidence": F.lit(1.0)})
    return nodes, edges


def peer_samples(qa: DataFrame, nodes: DataFrame) -> DataFrame:
    """qa (question_id, paper_id, question, answerable, answer_evidence_mapped, answer_evidence_sent, answer_free_form) -> samples with `dropped` (unanswerable, unmapped or null).

    Gold is the mapped nodes if each group has one, else what all evidence sentences map to.
    """
    base = qa.withColumn("groups", F.coalesce("answer_evidence_mapped", F.array().cast("array<struct<idx:array<int>>>")))
    ids = nodes.select("node_id")
    flat = base.select("question_id", "paper_id", F.posexplode("groups").alias("g", "m")).select("question_id", "g", F.explode("m.idx").alias("i"), "paper_id")
    hits = flat.select("question_id", "g", F.concat(F.lit("peerqa::"), "paper_id", F.lit("::"), F.col("i").cast("string")).alias("node_id")).join(ids, "node_id")
    mapped = hits.groupBy("question_id").agg(F.count_distinct("g").alias("met"), F.array_sort(F.collect_set("node_id")).alias("mapped"))
    e = base.select("question_id", "paper_id", F.posexplode(F.coalesce("answer_evidence_sent", F.array().cast("array<string>"))).alias("k", "evidence"))
    e = e.withColumn("evidence_id", F.concat("question_id", F.lit("#"), F.col("k").cast("string")))
    found = map_evidence(e, nodes).select("evidence_id", "node_id").join(e.select("evidence_id", "question_id"), "evidence_id")
    sent = found.groupBy("question_id").agg(F.every(F.col("node_id").isNotNull()).alias("all"), F.array_sort(F.collect_set("node_id")).alias("sent"))
    both = base.join(mapped, "question_id", "left").join(sent, "question_id", "left")
    whole = (F.size("groups") > 0) & (F.coalesce("met", F.lit(0)) == F.size("groups"))
    gold = F.when(whole, F.col("mapped")).when(F.col("all"), F.col("sent")).otherwise(F.array().cast("array<string>"))
    out = both.select(F.col("question_id").alias("query_id"), "paper_id", F.col("question").alias("query"), F.coalesce("answer_free_form", F.lit("")).alias("answer"), gold.alias("relevant_node_ids"), F.coalesce("answerable", F.lit(False)).alias("a"))
    return out.withColumn("dropped", F.when(~F.col("a"), "unanswerable").when(F.size("relevant_node_ids") == 0, "unmapped")).drop("a")


def quote_graph(rows: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (split, q_id, doc_name, question, text_quotes, img_quotes, gold_quotes, answer_short, ...) -> (nodes, samples).

    Of quotes of one id in a question the first stays. images (name, path) resolve image paths by whole name, else by last part.
    """
    none = "array<struct<quote_id:string,text:string,img_path:string,img_description:string,page_id:int,type:string>>"
    field = lambda c, k: F.transform(c, k)
    text = field("text_quotes", lambda q: F.struct(q["quote_id"].cast("string").alias("quote_id"), q["text"].alias("text"), F.lit(None).cast("string").alias("img_path"), F.lit(None).cast("string").alias("img_description"), q["page_id"].cast("int").alias("page_id"), F.lit("text").alias("type")))
    image = field("img_quotes", lambda q: F.struct(q["quote_id"].cast("string").alias("quote_id"), F.lit(None).cast("string").alias("text"), q["img_path"].alias("img_path"), q["img_description"].alias("img_description"), q["page_id"].cast("int").alias("page_id"), F.lit("image").alias("type")))
    quotes = F.concat(F.coalesce(text.cast(none), F.array().cast(none)), F.coalesce(image.cast(none), F.array().cast(none)))
    flat = rows.select("split", "q_id", "doc_name", F.posexplode(quotes).alias("place", "q")).select("split", "q_id", "doc_name", "place", "q.*")
    first = flat.withColumn("__n", F.row_number().over(Window.partitionBy("split", "q_id", "quote_id").orderBy("place"))).where("__n = 1").drop("__n")
    node_id = F.concat(F.lit("mmdocrag::"), "split", F.lit("::"), "doc_name", F.lit("::"), "type", F.lit(":q"), F.col("q_id").cast("string"), F.lit(":"), "quote_id")
    first = first.withColumn("node_id", node_id)
    path = F.col("img_path")
    placed = first
    if images is not None:
        last = images.select(F.substring_index("name", "/", -1).alias("__last"), "path").groupBy("__last").agg(F.min("path").alias("by_last"))
        whole = images.select(F.col("name").alias("__name"), F.col("path").alias("by_name"))
        placed = first.join(whole, F.col("img_path") == F.col("__name"), "left").join(last, F.substring_index("img_path", "/", -1) == F.col("__last"), "left")
        path = F.coalesce("by_name", "by_last", "img_path")
    nodes = placed.select("node_id", F.col("doc_name").alias("paper_id"), F.when(F.col("type") == "image", "Figure").otherwise("Sentence").alias("node_type"), F.when(F.col("type") == "text", F.coalesce("text", F.lit(""))).alias("text"), path.alias("image_path"), F.col("page_id").alias("page"), F.col("img_description").alias("text_view"))
    ids = first.groupBy("split", "q_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("quote_id", "node_id")))).alias("ids"), F.transform(F.sort_array(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"]).alias("candidate_node_ids"))
    joined = rows.join(ids, ["split", "q_id"])
    samples = joined.select(
        F.concat(F.lit("mmdocrag::"), "split", F.lit("::"), F.col("q_id").cast("string")).alias("query_id"), F.col("doc_name").alias("paper_id"), F.col("question").alias("query"), F.coalesce("answer_short", F.lit("")).alias("answer"),
        F.transform("gold_quotes", lambda g: F.element_at("ids", g.cast("string"))).alias("relevant_node_ids"), "candidate_node_ids",
    )
    return nodes, samples


def _flat_text(c: Column) -> Column:
    return collapsed(c)


def component_graph(docs: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (title, doc: JSON text with text, table and image maps) and images (name, path) -> (nodes, edges).

    A table's cells may point into its refs; its image is the first cell image that is there. An image that is not there gives no node.
    """
    lookup = images.select(F.col("name"), "path").unionByName(images.select(F.substring_index("name", "/", -1).alias("name"), "path")).groupBy("name").agg(F.min("path").alias("path"))

    def part(kind: str) -> DataFrame:
        return docs.select("title", F.explode(F.from_json(F.get_json_object("doc", f"$.{kind}"), "map<string,string>")).alias("id", "c"))

    ident = F.concat(F.lit("multimodalqa::"), safe_name(F.col("title")), F.lit("::"), F.col("id"))
    get = lambda p, c="c": F.get_json_object(c, p)
    texts = part("text").select(ident.alias("node_id"), F.col("title").alias("paper_id"), F.lit("Sentence").alias("node_type"), get("$.text").alias("text"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("text_view"))
    t = part("table").select(ident.alias("node_id"), "title", "c", F.from_json(get("$.refs"), "map<string,string>").alias("refs"), F.from_json(get("$.table"), "array<array<string>>").alias("rows"))

    def solved(cell):
        ref = F.get_json_object(cell, "$.ref")
        return F.coalesce(F.when(ref.isNotNull(), F.element_at("refs", ref)), cell)

    cell_text = lambda x: _flat_text(F.when(x.startswith("{"), F.coalesce(F.nullif(get("$.text", x), F.lit("")), get("$.value", x), F.lit(""))).otherwise(x))
    line = lambda row: F.array_join(F.filter(F.transform(row, lambda x: cell_text(solved(x))), lambda x: x != ""), "\t")
    own = _flat_text(get("$.text"))
    t = t.withColumn("text", F.when(own != "", own).otherwise(F.array_join(F.filter(F.transform("rows", line), lambda x: x != ""), "\n")))
    cells = t.select("node_id", F.posexplode_outer(F.flatten("rows")).alias("place", "cell"), "refs").select("node_id", "place", get("$.image.filename", solved(F.col("cell"))).alias("name"))
    last = lookup.select(F.col("name").alias("__last"), F.col("path").alias("by_last"))
    named = cells.where("name IS NOT NULL").join(lookup, "name", "left").join(last, F.substring_index("name", "/", -1) == F.col("__last"), "left").withColumn("path", F.coalesce("path", "by_last"))
    pictured = named.where("path IS NOT NULL").groupBy("node_id").agg(F.min_by("path", "place").alias("image_path"))
    tables = t.join(pictured, "node_id", "left").select("node_id", F.col("title").alias("paper_id"), F.lit("Table").alias("node_type"), "text", "image_path", F.lit(None).cast("string").alias("text_view"))
    caption = _flat_text(F.coalesce(get("$.caption.text"), F.when(~get("$.caption").startswith("{"), get("$.caption"))))
    name = get("$.filename")
    found = part("image").select(ident.alias("node_id"), "title", name.alias("name"), F.substring_index(name, "/", -1).alias("last"), caption.alias("caption"))
    found = found.join(lookup.withColumnRenamed("path", "p1"), "name", "left").join(lookup.select(F.col("name").alias("last"), F.col("path").alias("p2")), "last", "left").withColumn("image_path", F.coalesce("p1", "p2")).where("image_path IS NOT NULL")
    figures = found.select("node_id", F.col("title").alias("paper_id"), F.lit("Figure").alias("node_type"), F.lit(None).cast("string").alias("text"), "image_path", F.col("caption").alias("text_view"))
    captioned = found.where("caption <> ''")
    captions = captioned.select(F.concat("node_id", F.lit(":caption")).alias("node_id"), F.col("title").alias("paper_id"), F.lit("Caption").alias("node_type"), F.col("caption").alias("text"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("text_view"))
    nodes = texts.unionByName(tables).where("text <> ''").unionByName(figures).unionByName(captions)
    edges = captioned.select(F.concat("node_id", F.lit(":caption")).alias("src"), F.col("node_id").alias("dst"), F.lit("caption_of").alias("relation"), F.lit(1.0).alias("confidence"))
    return nodes, edges


def component_samples(qa: DataFrame, index: DataFrame) -> DataFrame:
    """qa (qid, question, answer, evidences) and index (title, component_id, node_id) -> samples whose every evidence is found, by title and id or by an id that only one title has."""
    alone = index.groupBy("component_id").agg(F.count("*").alias("n"), F.first("node_id").alias("only")).where("n = 1").select("component_id", "only")
    e = qa.select("qid", F.posexplode("evidences").alias("k", "e")).select("qid", "k", F.col("e.gold_webpage_title").alias("title"), F.col("e.gold_component_id").alias("component_id"), F.coalesce("e.mmqa_doc_modality", F.lit("text")).alias("m"))
    found = e.join(index, ["title", "component_id"], "left").join(alone, "component_id", "left").withColumn("node_id", F.coalesce("node_id", "only"))
    seen = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]))
    by = found.groupBy("qid").agg(F.every(F.col("node_id").isNotNull()).alias("whole"), seen("node_id").alias("relevant_node_ids"), seen("m").alias("required_modalities")).where("whole")
    return qa.join(by, "qid").select(F.concat(F.lit("multimodalqa::"), F.col("qid").cast("string")).alias("query_id"), F.col("question").alias("query"), F.coalesce("answer", F.lit("")).alias("answer"), "relevant_node_ids", "required_modalities")


def page_node_id(dataset: str, doc_id: Column, page: Column) -> Column:
    return F.concat(F.lit(f"{dataset}::"), safe_name(doc_id), F.lit("::page:"), page.cast("string"))


def page_nodes(pages: DataFrame, dataset: str) -> DataFrame:
    """pages (doc_id, page from 1, image_path) -> figure nodes."""
    return pages.select(page_node_id(dataset, F.col("doc_id"), F.col("page")).alias("node_id"), F.col("doc_id").alias("paper_id"), F.lit("Figure").alias("node_type"), F.lit(None).cast("string").alias("text"), "image_path", F.col("page").cast("int").alias("page"))


def scanned_pages(spark: SparkSession, path: str, patterns: str = "*.{png,jpg,jpeg,webp}") -> tuple[DataFrame, DataFrame]:
    """(pages, unreadable) of image files below path: pages (doc_id, page from 1, image_path) for page_nodes, and the paths of files whose first bytes are no image's.

    A document is a folder; its pages are ordered by the last number in their names, then by name. Only the first bytes of a file are looked at.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).option("recursiveFileLookup", True).load(path)
    judged = files.select("path", image_kind(F.col("content")).alias("kind"))
    name = F.substring_index(F.url_decode("path"), "/", -1)
    number = F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long")
    good = judged.where("kind IS NOT NULL").select(F.element_at(F.split(F.url_decode("path"), "/"), -2).alias("doc_id"), F.col("path").alias("image_path"), number.alias("n"), name.alias("name"))
    order = Window.partitionBy("doc_id").orderBy("n", "name")
    return good.withColumn("page", F.row_number().over(order)).select("doc_id", "page", "image_path"), judged.where("kind IS NULL").select("path")


def literal_list(c: Column) -> Column:
    """A list written as text, with single or double quotes, as strings; anything else is empty."""
    inner = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^[\[(](.*)[\])]$", 1)
    parts = F.transform(F.regexp_extract_all(inner, F.lit(r"'[^']*'|\"[^\"]*\"|[^,\s][^,]*"), F.lit(0)), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(parts)


#: Modality names of one of the sets.
MODALITIES = {"table": "table", "chart": "figure", "figure": "figure", "pure-text (plain-text)": "text", "generalized-text (layout)": "text"}


def modalities(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv])
    return F.array_distinct(F.transform(literal_list(c), lambda x: F.coalesce(F.try_element_at(names, F.lower(x)), F.lower(x))))


def page_samples(rows: DataFrame, nodes: DataFrame, dataset: str = "mmlongbench_doc", max_documents: int | None = None) -> DataFrame:
    """rows (row, doc_id, question, answer, evidence_pages, evidence_sources) -> samples over their document's pages; rows without gold pages go.

    max_documents keeps rows of the documents that come first (by `row`).
    """
    asked = rows.withColumn("pages", F.transform(literal_list(F.col("evidence_pages")), lambda x: x.cast("int"))).where(F.size("pages") > 0)
    if max_documents is not None:
        first = asked.groupBy("doc_id").agg(F.min("row").alias("__r")).orderBy("__r").limit(max_documents).select("doc_id")
        asked = asked.join(first, "doc_id", "left_semi")
    pages = nodes.select(F.col("paper_id").alias("doc_id"), "node_id", "page")
    own = pages.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "node_id"))), lambda x: x["node_id"]).alias("candidate_node_ids"), F.collect_set("page").alias("have"))
    both = asked.join(own, "doc_id").where(F.size(F.array_except("pages", "have")) == 0)
    gold = F.transform(F.array_distinct("pages"), lambda p: page_node_id(dataset, F.col("doc_id"), p))
    return both.select(F.concat(F.lit(f"{dataset}::"), F.col("row").cast("string")).alias("query_id"), F.col("doc_id").alias("paper_id"), F.col("question").alias("query"), F.coalesce("answer", F.lit("")).alias("answer"), gold.alias("relevant_node_ids"), "candidate_node_ids", modalities(F.col("evidence_sources")).alias("required_modalities"))


def named_page_samples(qa: DataFrame, nodes: DataFrame, dataset: str = "m3docvqa") -> DataFrame:
    """qa (qid, question, answer, evidences of gold_page and mmqa_doc_modality) -> samples; pages are found by file name or stem, and a row with a lost page goes."""
    name = F.substring_index("image_path", "/", -1)
    known = nodes.select(F.explode(F.array(name, F.regexp_replace(name, r"\.[^.]*$", ""))).alias("key"), "node_id").dropDuplicates(["key"])
    e = qa.select("qid", F.posexplode("evidences").alias("k", "e")).select("qid", "k", F.substring_index("e.gold_page", "/", -1).alias("n"), F.coalesce("e.mmqa_doc_modality", F.lit("image")).alias("m"))
    by_name = known.withColumnRenamed("key", "n").withColumnRenamed("node_id", "a")
    by_stem = known.withColumnRenamed("key", "s").withColumnRenamed("node_id", "b")
    found = e.withColumn("s", F.regexp_replace("n", r"\.[^.]*$", "")).join(by_name, "n", "left").join(by_stem, "s", "left").withColumn("node_id", F.coalesce("a", "b"))
    seen = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]))
    by = found.groupBy("qid").agg(F.every(F.col("node_id").isNotNull()).alias("whole"), seen("node_id").alias("relevant_node_ids"), seen("m").alias("required_modalities")).where("whole")
    return qa.join(by, "qid").select(F.concat(F.lit(f"{dataset}::"), F.col("qid").cast("string")).alias("query_id"), F.col("question").alias("query"), F.coalesce("answer", F.lit("")).alias("answer"), "relevant_node_ids", "required_modalities")


def with_split(samples: DataFrame, group: str, train: int = 70, dev: int = 15) -> DataFrame:
    """Samples with their split; a group is never parted."""
    return samples.withColumn("split", grouped_split(F.col(group), train, dev))


def check_preparation(report: dict, allow_partial: bool = False) -> None:
    """Missing images, evidence or papers are an error unless a partial set will do."""
    lost = {k: v for k, v in report.items() if k.startswith("missing") and v}
    if lost and not allow_partial:
        raise ValueError(f"incomplete data: {lost}")


def graph_digest(nodes: DataFrame, edges: DataFrame) -> str:
    """A digest of a graph's rows, whatever their order and partitions: what is trained on a graph is kept beside it."""
    parts = []
    for df, names in ((nodes, ("node_id", "paper_id", "node_type", "text", "image_path")), (edges, ("src", "dst", "relation", "confidence"))):
        h = F.xxhash64(*[c for c in names if c in df.columns])
        parts += [str(x) for x in df.agg(F.count("*"), F.bit_xor(h), F.sum((F.pmod(h, F.lit(1 << 31))).cast("decimal(38,0)"))).first()]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def check_leakage(train: DataFrame, test: DataFrame, trained_on: str | None = None, graph: str | None = None) -> None:
    """A query in both the training and the test samples is an error, as is a model trained on another graph (digests of both, where the training kept one)."""
    if trained_on is not None and trained_on != graph:
        raise ValueError("the model was trained on another graph")
    both = train.select("query_id").intersect(test.select("query_id")).limit(5).collect()
    if both:
        raise ValueError(f"queries in training and test: {[r[0] for r in both]}")
