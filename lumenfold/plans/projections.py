"""The driver's tables seen as evidence graphs, vectors and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folded_sentences, sentence_parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few files dealt over all cores before costly work; one of more parts than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def sentences(docs: DataFrame) -> DataFrame:
    """Sentence nodes of documents; the paper is the source, `ord` the place in the text."""
    docs = spread(docs.select("doc_id", "source", "text"))
    parts = docs.select("doc_id", "source", sentence_parts(F.col("text")).alias("parts"))
    split = parts.select("doc_id", "source", F.posexplode(folded_sentences(F.col("parts"))).alias("ord", "text"))
    return split.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("ord").cast("string")).alias("node_id"), F.col("source").alias("paper_id"), F.lit("Sentence").alias("node_type"), "text", "doc_id", "ord"
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    types = F.array(*[F.lit(t) for t in ("Sentence", "Figure", "Table", "Caption", "ChartData")])
    return embeddings.select(
        F.col("vec_id").cast("string").alias("node_id"), (F.col("vec_id") % 20).cast("string").alias("paper_id"), F.get(types, F.col("label") % 5).alias("node_type"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"), "label"
    )


def vector_queries(embeddings: DataFrame) -> DataFrame:
    """Every fiftieth vector asks."""
    return embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by (order, line number), which is not unique in the table."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum("l_quantity").cast("long").alias("qty"), F.min("l_discount").alias("disc")
    )


def _id(mark: str, *cols) -> F.Column:
    parts = [F.lit(mark)]
    for i, c in enumerate(cols):
        parts += [F.lit(":")] * (i > 0) + [F.col(c).cast("string")]
    return F.concat(*parts)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a customer is a paper, an order a figure with its caption and chart data, its lines sentences."""
    lines, orders = order_lines(spark, sf_dir), table(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderkey"))
    none = F.lit(None).cast("string")
    paper = _id("c", "o_custkey").alias("paper_id")

    def node(df, node_id, kind, text, image=none):
        return df.select(node_id.alias("node_id"), paper, F.lit(kind).alias("node_type"), text.alias("text"), image.alias("image_path"))

    said = F.concat(F.lit("Line "), F.col("ln").cast("string"), F.lit(" of order "), F.col("ok").cast("string"), F.lit(" ships "), F.col("qty").cast("string"), F.lit(" units."))
    nodes = (
        node(lines.join(orders, "ok"), _id("l", "ok", "ln"), "Sentence", said)
        .unionByName(node(orders, _id("o", "ok"), "Figure", none, F.concat(F.lit("figures/"), F.col("ok").cast("string"), F.lit(".png"))))
        .unionByName(node(orders.where("ok % 3 <> 0"), _id("k", "ok"), "Caption", F.concat(F.lit("Figure "), F.col("ok").cast("string"), F.lit(". Priority "), F.col("o_orderpriority"))))
        .unionByName(node(orders.where("ok % 4 = 0"), _id("d", "ok"), "ChartData", F.concat(F.lit("Total "), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))))
    )

    def edge(df, src, dst, relation, confidence=F.lit(1.0)):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), confidence.alias("confidence"))

    following = lines.withColumn("nxt", F.lead("ln").over(Window.partitionBy("ok").orderBy("ln"))).where("nxt IS NOT NULL")
    edges = (
        edge(lines.where("ln % 2 = 1"), _id("l", "ok", "ln"), _id("o", "ok"), "refers_to")
        .unionByName(edge(orders.where("ok % 3 <> 0"), _id("k", "ok"), _id("o", "ok"), "caption_of"))
        .unionByName(edge(orders.where("ok % 4 = 0"), _id("d", "ok"), _id("o", "ok"), "derived_from"))
        .unionByName(edge(following, _id("l", "ok", "ln"), _id("l", "ok", "nxt"), "next_sentence", F.round(1 - 3 * F.col("disc"), 6)))
    )
    return nodes, edges


def graph_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("query_id")).distinct()
    return q.select("query_id", F.lit("units").alias("metric"), F.lit("priority").alias("unit"), F.col("query_id").cast("double").alias("value"), F.array(F.lit("URGENT"), F.lit("total")).alias("conditions"))


def graph_hits(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """A region asks; its hits are its dearest lines."""
    lines, orders = order_lines(spark, sf_dir), table(spark, sf_dir, "orders")
    cust, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = lines.join(orders, F.col("ok") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = own.select(F.col("n_regionkey").alias("query_id"), _id("l", "ok", "ln").alias("node_id"), _id("c", "o_custkey").alias("paper_id"), (F.col("cents") / 1e7).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a small paper of layout blocks: a title, an image with its caption or without a file, text, a table, and for some an image and a caption without labels."""
    o = table(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderkey").cast("string"))
    lit, field = F.lit, lambda name, *parts: F.concat(*parts).alias(name)
    page = lambda n: lit(n).alias("page_idx")
    kind = lambda k: lit(k).alias("type")
    body = F.concat(lit("<table><tr><td>Key</td><td>Status</td></tr><tr><td>"), "ok", lit("</td><td>"), "o_orderstatus", lit("</td></tr></table>"))
    image = F.struct(kind("image"), field("img_path", lit("f"), "ok", lit(".png")), F.array(lit("Figure 1. Priority"), F.concat("o_orderpriority", lit("."))).alias("img_caption"), page(0))
    rows = [
        F.to_json(F.struct(kind("title"), field("text", lit("Order "), "ok"), page(0))),
        F.when(F.col("o_orderkey") % 4 == 0, F.to_json(F.struct(kind("image"), lit("no path").alias("text"), page(0)))).otherwise(F.to_json(image)),
        F.to_json(F.struct(kind("text"), field("text", lit("As shown in Fig. 1, sales grow.  They grow fast in order "), "ok", lit(".")), page(0))),
        F.to_json(F.struct(kind("table"), F.array(lit("Table 2. Lines")).alias("table_caption"), body.alias("table_body"), page(1))),
        F.to_json(F.struct(kind("text"), field("content", lit("Table 2 reports status "), "o_orderstatus", lit(".")), page(1))),
    ]
    loose = [
        F.to_json(F.struct(lit("image").alias("category"), lit("a.png").alias("path"), lit(3).alias("page"))),
        F.to_json(F.struct(lit("caption").alias("category"), field("text", lit("Left: "), "o_orderpriority", lit(".")), lit(3).alias("page"))),
    ]
    listed = F.concat(F.array(*rows), F.when(F.col("o_orderkey") % 5 == 0, F.array(*loose)).otherwise(F.array().cast("array<string>")))
    return o.select(F.concat(lit("o"), "ok").alias("paper_id"), F.posexplode(listed).alias("index", "block"))


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that names figures and tables in several ways for every line item."""
    i = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    t = F.concat(F.lit("As in Fig. "), k, F.lit("b and figure "), n, F.lit(", FIG."), k, F.lit("B; Figs. 3 or Table "), n, F.lit(", Tab. "), k, F.lit("A, 表 "), n, F.lit("."))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", t.alias("t"))
