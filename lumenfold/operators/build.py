"""Building evidence graphs: layout blocks to nodes and edges, captions to their figures and tables, text views, forests as text.

Blocks are rows (paper_id, index, block): the place in reading order and the block as a JSON string; fields are looked up
under several names, as parsers differ.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.kernels import html_table_text
from ..sources.scratch import Scratch

NODE = ("node_id", "paper_id", "node_type", "text", "image_path", "page", "bbox", "parser_block_id", "source_index", "caption_target")
#: Block types by what they become.
KINDS = {
    "text": ("text", "paragraph", "para", "title"),
    "image": ("image", "figure", "img"),
    "table": ("table", "table_body"),
    "caption": ("image_caption", "figure_caption", "caption"),
    "table_caption": ("table_caption",),
}


#: Fields of a block that are looked at. They become columns by one reading of the JSON.
FIELDS = (
    "type", "category", "text", "content", "bbox", "box", "img_path", "image_path", "path", "table_body", "html", "markdown", "page_idx", "page", "page_number", "id",
    "img_caption", "caption", "table_caption", "table_footnote",
)


def _get(path: str) -> Column:
    """A field, or a place within `content`."""
    _, name, *inner = path.split(".")
    return F.when(F.ltrim(F.col(f"__{name}")).startswith("{"), F.get_json_object("block", path)) if inner else F.col(f"__{name}")


def _filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _joined(*paths: str) -> Column:
    """A string, or a list of strings joined by blanks, under the first name that has one."""
    raw = _filled(*[_get(p) for p in paths])
    listed = F.from_json(raw, "array<string>")
    return F.trim(F.coalesce(F.when(raw.startswith("["), F.array_join(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != ""), " ")).otherwise(raw), F.lit("")))


def routed(blocks: DataFrame, base: str | None = None) -> DataFrame:
    """Blocks with what they become (`kind`), their text, page (from 1), box, image path and table parts."""
    blocks = blocks.select("paper_id", "index", "block", F.json_tuple("block", *FIELDS).alias(*[f"__{f}" for f in FIELDS]))
    kind = F.lit(None).cast("string")
    name = F.lower(F.coalesce(_get("$.type"), _get("$.category")))
    for k, names in KINDS.items():
        kind = F.when(name.isin(list(names)), F.lit(k)).otherwise(kind)
    content = _get("$.content")
    flat = F.when(~F.coalesce(content, F.lit("")).rlike(r"^\s*[\[{]"), content)
    box = F.from_json(_filled(_get("$.bbox"), _get("$.box")), "array<double>")
    image = _filled(_get("$.img_path"), _get("$.image_path"), _get("$.path"), _get("$.content.img_path"), _get("$.content.image_source.path"))
    placed = image if base is None else F.when(image.startswith("/"), image).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), image))
    html = _filled(_get("$.table_body"), _get("$.html"), _get("$.content.html"))
    body = F.when(html.isNotNull(), html_table_text(html)).otherwise(F.trim(F.coalesce(_filled(_get("$.markdown"), _get("$.content.markdown")), F.lit(""))))
    return blocks.select(
        "paper_id",
        "index",
        kind.alias("kind"),
        T.collapsed(F.coalesce(_get("$.text"), flat)).alias("text"),
        F.when(_get("$.page_idx").isNotNull(), _get("$.page_idx").cast("int") + 1).otherwise(F.coalesce(_get("$.page").cast("int"), _get("$.page_number").cast("int"))).alias("page"),
        F.when(F.size(box) == 4, F.struct(box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"), box[3].alias("y1"))).alias("bbox"),
        F.coalesce(_get("$.id"), F.col("index").cast("string")).alias("parser_block_id"),
        F.when(image.isNotNull(), placed).alias("image_path"),
        _joined("$.img_caption", "$.caption").alias("image_caption"),
        F.when(kind == "table", body).alias("body"),
        _joined("$.table_caption", "$.content.table_caption").alias("table_caption"),
        _joined("$.table_footnote", "$.content.table_footnote").alias("footnote"),
    )


def _first_label(labels: Column) -> Column:
    return F.get(labels, F.lit(0))


def warnings_of(r: DataFrame) -> DataFrame:
    """Blocks that become nothing for want of an image, or of a body and an image."""
    no_image = (F.col("kind") == "image") & F.col("image_path").isNull()
    no_table = (F.col("kind") == "table") & (F.coalesce("body", F.lit("")) == "") & F.col("image_path").isNull()
    return r.where(no_image | no_table).select("paper_id", "parser_block_id", F.when(no_image, "figure without image").otherwise("table without body or image").alias("warning"))


def blocks_to_nodes(r: DataFrame) -> DataFrame:
    """Nodes of routed blocks, each with its label (`label`), sentences with their place in the block (`part`)."""
    none, where = F.lit(None).cast("string"), ("page", "bbox", "parser_block_id")

    def node(df, node_id, kind, text, image=none, target=none, label=none, part=F.lit(0)):
        return df.select(node_id.alias("node_id"), "paper_id", F.lit(kind).alias("node_type"), text.alias("text"), image.alias("image_path"), *where, F.col("index").alias("source_index"), target.alias("caption_target"), label.alias("label"), part.cast("int").alias("part"))

    def name(kind: str, *rest: Column):
        return F.concat(F.col("paper_id"), F.lit(f":{kind}:"), F.col("index").cast("string"), *rest)

    split = r.where("kind = 'text'").withColumn("parts", T.sentence_parts(F.col("text"))).select("*", F.posexplode(T.folded_sentences(F.col("parts"))).alias("part", "sentence"))
    figures = r.where("kind = 'image' AND image_path IS NOT NULL")
    tables = r.where("kind = 'table' AND (coalesce(body, '') <> '' OR image_path IS NOT NULL)")
    captions, table_captions = r.where("kind = 'caption' AND text <> ''"), r.where("kind = 'table_caption' AND text <> ''")
    figure_label = _first_label(T.figure_labels(F.coalesce(F.nullif("image_caption", F.lit("")), F.col("text"))))
    all_text = F.array_join(F.filter(F.array("table_caption", F.coalesce("body", F.lit("")), "footnote"), lambda x: x != ""), "\n")
    return (
        node(split, name("sentence", F.lit(":"), F.col("part").cast("string")), "Sentence", F.col("sentence"), part=F.col("part"))
        .unionByName(node(figures, name("figure"), "Figure", none, F.col("image_path"), label=figure_label))
        .unionByName(node(figures.where("image_caption <> ''"), name("caption", F.lit(":embedded")), "Caption", F.col("image_caption")))
        .unionByName(node(tables, name("table"), "Table", all_text, F.col("image_path"), label=_first_label(T.table_labels(F.col("table_caption")))))
        .unionByName(node(tables.where("table_caption <> ''"), name("caption", F.lit(":table")), "Caption", F.col("table_caption"), target=F.lit("table")))
        .unionByName(node(captions, name("caption"), "Caption", F.col("text"), target=F.lit("figure"), label=_first_label(T.figure_labels(F.col("text")))))
        .unionByName(node(table_captions, name("caption"), "Caption", F.col("text"), target=F.lit("table"), label=_first_label(T.table_labels(F.col("text")))))
    )


def _edge(df: DataFrame, src, dst, relation: str, confidence: float = 1.0) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))


def next_sentences(nodes: DataFrame) -> DataFrame:
    """Neighbours in reading order, across blocks."""
    w = Window.partitionBy("paper_id").orderBy("source_index", "part", "node_id")
    following = nodes.where("node_type = 'Sentence'").withColumn("nxt", F.lead("node_id").over(w)).where("nxt IS NOT NULL")
    return _edge(following, "node_id", "nxt", "next_sentence")


def labelled_captions(nodes: DataFrame) -> DataFrame:
    """Standing captions to the figure or table of their label; where a label comes twice the later block has it."""
    last = lambda df: df.groupBy("paper_id", "what", "label").agg(F.max_by("node_id", "source_index").alias("node_id"))
    targets = last(nodes.where("node_type IN ('Figure', 'Table') AND label IS NOT NULL").withColumn("what", F.lower("node_type")))
    captions = last(nodes.where("node_type = 'Caption' AND label IS NOT NULL").withColumn("what", F.col("caption_target")))
    return _edge(captions.withColumnRenamed("node_id", "c").join(targets, ["paper_id", "what", "label"]), "c", "node_id", "caption_of")


def references(nodes: DataFrame) -> DataFrame:
    """Sentences to the figures and tables whose labels they name."""
    last = nodes.where("node_type IN ('Figure', 'Table') AND label IS NOT NULL").groupBy("paper_id", "node_type", "label").agg(F.max_by("node_id", "source_index").alias("dst"))
    s = nodes.where("node_type = 'Sentence'")
    named = lambda labels, kind: s.select("paper_id", F.col("node_id").alias("src"), F.lit(kind).alias("node_type"), F.explode(labels).alias("label"))
    both = named(T.figure_labels(F.col("text")), "Figure").unionByName(named(T.table_labels(F.col("text")), "Table"))
    return _edge(both.join(last, ["paper_id", "node_type", "label"]), "src", "dst", "refers_to")


def nearest_pairs(captions: list[tuple[int, str]], targets: list[tuple[int, str]]) -> list[tuple[str, str]]:
    """Each caption in turn takes the free target of least distance in reading order; equal ones in their order."""
    free, out = sorted(targets), []
    for place, caption in sorted(captions):
        if free:
            best = min(free, key=lambda t: abs(t[0] - place))
            free.remove(best)
            out.append((caption, best[1]))
    return out


def nearest_captions(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """Captions and targets that no caption_of edge of `linked` joins yet, paired within (paper, page, type) by reading order.

    A page's captions and targets are one row; Python sees batches of pages, and none without both.
    """
    orphans = nodes.where("node_type = 'Caption'").join(linked.select(F.col("src").alias("node_id")), "node_id", "left_anti").withColumn("what", F.when(F.col("caption_target") == "table", "Table").otherwise("Figure"))
    free = nodes.where("node_type IN ('Figure', 'Table')").join(linked.select(F.col("dst").alias("node_id")), "node_id", "left_anti").withColumn("what", F.col("node_type"))
    spots = lambda df, name: df.groupBy("paper_id", "what", F.coalesce("page", F.lit(-1)).alias("page")).agg(F.collect_list(F.struct("source_index", "node_id")).alias(name))
    met = spots(orphans, "captions").join(spots(free, "targets"), ["paper_id", "what", "page"])

    def pair(captions: pa.Array, targets: pa.Array) -> pa.Array:
        listed = lambda found: [(x["source_index"], x["node_id"]) for x in found]
        made = [[{"src": a, "dst": b} for a, b in nearest_pairs(listed(c), listed(t))] for c, t in zip(captions.to_pylist(), targets.to_pylist(), strict=True)]
        return pa.array(made, pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string())])))

    paired = met.select(F.explode(F.arrow_udf(pair, "array<struct<src:string,dst:string>>")("captions", "targets")).alias("p")).select("p.*")
    return _edge(paired, "src", "dst", "caption_of", 0.9)


def blocks_to_graph(blocks: DataFrame, base: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, warnings) of layout blocks; what blocks become is written once, as edges of all kinds start from it."""
    scratch = Scratch(blocks.sparkSession, "blocks")
    r = scratch.write(routed(blocks, base))
    nodes = scratch.write(blocks_to_nodes(r))
    inner = nodes.where("node_type = 'Caption' AND node_id LIKE '%:embedded' OR node_type = 'Caption' AND node_id LIKE '%:table'")
    owner = F.concat("paper_id", F.when(F.col("node_id").endswith(":embedded"), ":figure:").otherwise(":table:"), F.col("source_index").cast("string"))
    own = _edge(inner.withColumn("dst", owner), "node_id", "dst", "caption_of")
    linked = own.unionByName(labelled_captions(nodes))
    edges = next_sentences(nodes).unionByName(linked).unionByName(nearest_captions(nodes, linked)).unionByName(references(nodes))
    return nodes.select(*NODE), edges, warnings_of(r)


def attach_chart_data(nodes: DataFrame, charts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chart tables (figure_id, linearized_table, confidence); what hangs on no figure is an error."""
    figures = nodes.select(F.col("node_id").alias("figure_id"), "paper_id", "node_type", "page")
    found = charts.join(figures, "figure_id", "left")
    ok = F.when(F.coalesce(F.col("node_type"), F.lit("")) != "Figure", F.raise_error(F.concat(F.lit("no figure "), F.col("figure_id")))).otherwise(F.lit(True))
    found = found.where(ok).withColumn("node_id", F.concat("paper_id", F.lit(":chart_data:"), F.substring_index("figure_id", ":", -1)))
    made = found.select("node_id", "paper_id", F.lit("ChartData").alias("node_type"), F.col("linearized_table").alias("text"), "page", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    return made, found.select(F.col("node_id").alias("src"), F.col("figure_id").alias("dst"), F.lit("derived_from").alias("relation"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def figure_text_views(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id of every figure and its text view: the distinct texts that caption, refer to or derive from it, first seen first (by `ord` of edges, else source id), one a line."""
    order = F.col("ord") if "ord" in edges.columns else F.lit(0)
    linked = edges.where(F.col("relation").isin("caption_of", "refers_to", "derived_from")).select("src", "dst", order.alias("o"))
    texts = nodes.select(F.col("node_id").alias("src"), F.trim(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    figures = nodes.where("node_type = 'Figure'").select("node_id")
    rows = figures.join(linked, F.col("node_id") == F.col("dst")).join(texts, "src")
    lines = rows.groupBy("node_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("o", "src", "t"))), lambda x: x["t"])).alias("lines"))
    return figures.join(lines, "node_id", "left").select("node_id", F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n").alias("text_view"))


def listed_figures(nodes: DataFrame) -> DataFrame:
    """Figures with their paper, page (null where nodes have none) and image."""
    page = F.col("page") if "page" in nodes.columns else F.lit(None).cast("int")
    return nodes.where("node_type = 'Figure'").select("node_id", "paper_id", page.alias("page"), "image_path")


def serialized(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """trees (query_id, tree, paper_id, node_ids) -> query_id, context, image_paths: nodes by page (unknown last), type and id under a heading for each tree."""
    page = F.col("page") if "page" in nodes.columns else F.lit(None).cast("int")
    view = F.col("text_view") if "text_view" in nodes.columns else F.lit("")
    info = nodes.select("node_id", "node_type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("image_path", F.lit("")).alias("image_path"), page.alias("page"), F.coalesce(view, F.lit("")).alias("view"))
    rows = trees.select("query_id", "tree", "paper_id", F.explode("node_ids").alias("node_id")).join(info, "node_id")
    at = F.concat(F.lit("page="), F.coalesce(F.col("page").cast("string"), F.lit("unknown")))
    head = F.concat(F.lit("["), F.col("node_id"), F.lit("] "), F.col("node_type"), F.lit(" ("), at)
    line = F.when(F.col("node_type") == "Figure", F.concat(head, F.lit("); text_view="), F.col("view"))).otherwise(F.concat(head, F.lit("): "), F.col("text")))
    order = F.struct(F.coalesce("page", F.lit(10**9)).alias("p"), "node_type", "node_id", line.alias("line"), F.when(F.col("node_type").isin("Figure", "Table"), F.col("image_path")).otherwise("").alias("image"))
    parts = rows.groupBy("query_id", "tree", "paper_id").agg(F.sort_array(F.collect_list(order)).alias("rows"))
    head = F.concat(F.lit("## Evidence component "), F.col("tree").cast("string"), F.lit("; paper="), F.col("paper_id"))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    whole = parts.select("query_id", F.struct("tree", text.alias("text"), F.filter(F.transform("rows", lambda r: r["image"]), lambda x: x != "").alias("images")).alias("part"))
    done = whole.groupBy("query_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return done.select("query_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("context"), F.flatten(F.transform("parts", lambda p: p["images"])).alias("image_paths"))
