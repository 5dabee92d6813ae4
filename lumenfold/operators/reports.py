"""Reports on graphs and prepared sets, answers of language models, and the place of sentences on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fences_stripped


def index_report(nodes: DataFrame, dimension: int) -> DataFrame:
    """One row: what an index is made from (texts are all nodes but figures and tables) and its vectors' dimension."""
    kind = F.col("node_type")
    return nodes.agg(F.count_if(~kind.isin("Figure", "Table")).alias("text_nodes"), F.count_if(kind == "Figure").alias("figure_nodes"), F.count_if(kind == "Table").alias("table_nodes")).withColumn("dimension", F.lit(dimension))


def embedding_inputs(nodes: DataFrame) -> DataFrame:
    """node_id, how it is embedded (text, mixed, image) and what the embedder is given: a table its text and image, as far as it has them."""
    filled = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    view = filled("text_view") if "text_view" in nodes.columns else F.lit(None).cast("string")
    words, kind = F.coalesce(filled("text"), view), F.col("node_type")
    how = F.when(kind == "Figure", "image").when(kind == "Table", "mixed").otherwise("text")
    return nodes.select("node_id", how.alias("how"), F.when(kind != "Figure", words).alias("text"), F.when(kind.isin("Figure", "Table"), filled("image_path")).alias("image"))


def preparation_report(nodes: DataFrame, edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(name, value) of a prepared set: papers, nodes by type, edges by relation, samples kept, and dropped ones by reason (`dropped`, null for kept ones)."""
    named = lambda df, prefix, c: df.groupBy(F.concat(F.lit(prefix), F.col(c)).alias("name")).agg(F.count("*").alias("value"))
    papers = nodes.agg(F.count_distinct("paper_id").alias("value")).select(F.lit("papers").alias("name"), "value")
    kept = samples.agg(F.count_if(F.col("dropped").isNull()).alias("value")).select(F.lit("samples").alias("name"), "value")
    return papers.unionByName(named(nodes, "nodes.", "node_type")).unionByName(named(edges, "edges.", "relation")).unionByName(kept).unionByName(named(samples.where("dropped IS NOT NULL"), "dropped.", "dropped"))


def summarised(report: DataFrame) -> DataFrame:
    """A report's lists as their lengths; other columns stay."""
    return report.select(*[F.size(F.coalesce(F.col(f.name), F.array())).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in report.schema])


def run_summary(reports: DataFrame) -> DataFrame:
    """reports (dataset, split, run, metric, value) -> one row for each dataset and split: runs and the best run of each metric, the first by name at ties."""
    best = reports.groupBy("dataset", "split", "metric").agg(F.max("value").alias("value"), F.count_distinct("run").alias("runs"))
    least = reports.join(best, ["dataset", "split", "metric", "value"]).groupBy("dataset", "split", "metric", "value", "runs").agg(F.min("run").alias("best_run"))
    return least.groupBy("dataset", "split").agg(F.max("runs").alias("runs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "best_run")))).alias("best_runs"))


# ------------------------------------------------------------------------------------------------ answers


def score_components(hits: DataFrame, scorers: list[str], others: Column | None = None) -> DataFrame:
    """hits with `components`: each scorer's value by name, without null ones; a scorer of the same name in `others` (a map) is replaced."""
    own = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s).alias("k"), F.col(s).cast("double").alias("v")) for s in scorers]), lambda x: x["v"].isNotNull()))
    if others is not None:
        own = F.map_concat(F.map_filter(others, lambda k, v: ~F.map_contains_key(own, k)), own)
    return hits.withColumn("components", own)


def component(name: str, default: float = 0.0) -> Column:
    """A hit's value of a scorer, or the default."""
    return F.coalesce(F.try_element_at("components", F.lit(name)), F.lit(default))


def responses(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id and `response`: its hits by place as a JSON list of id, paper, type, text, image and score."""
    info = nodes.select("node_id", F.col("text").alias("t"), F.col("image_path").alias("i"))
    shown = hits.join(info, "node_id", "left").select("query_id", F.struct("pos", F.struct("node_id", "paper_id", "node_type", F.col("t").alias("text"), F.col("i").alias("image_path"), "score").alias("hit")).alias("h"))
    listed = shown.groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("h"))
    return listed.select("query_id", F.to_json(F.transform("h", lambda x: x["hit"])).alias("response"))


def parsed_answers(raw: DataFrame) -> DataFrame:
    """raw (query_id, output) -> query_id, answer, node_ids (each id once, in order), valid: a JSON object, fenced or not, with a text `answer` and a list `evidence_ids`.

    Without one, the whole output is the answer, nothing is cited and it is not valid.
    """
    body = fences_stripped(F.regexp_replace(F.coalesce("output", F.lit("")), r"^\s*```json", "```"))
    made = F.from_json(body, "answer string, evidence_ids array<string>")
    valid = F.coalesce(made["answer"].isNotNull(), F.lit(False))
    ids = F.array_distinct(F.filter(F.coalesce(made["evidence_ids"], F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return raw.select("query_id", F.when(valid, made["answer"]).otherwise(F.coalesce("output", F.lit(""))).alias("answer"), F.when(valid, ids).otherwise(F.array().cast("array<string>")).alias("node_ids"), valid.alias("valid"))


def checked_citations(answers: DataFrame, forest: DataFrame) -> DataFrame:
    """answers (query_id, node_ids) as they are; one that cites a node outside its query's forest (query_id, node_id) is an error."""
    from .evaluate import unknown_citations

    lost = unknown_citations(answers.select("query_id", F.explode("node_ids").alias("node_id")), forest).groupBy("query_id").agg(F.min("node_id").alias("__lost"))
    both = answers.join(lost, "query_id", "left")
    return both.where(F.when(F.col("__lost").isNotNull(), F.raise_error(F.concat(F.lit("cited outside the evidence: "), F.col("__lost")))).otherwise(F.lit(True))).drop("__lost")


def answered(questions: DataFrame, contexts: DataFrame, generate) -> DataFrame:
    """questions (query_id, query) and contexts (query_id, context, image_paths) -> parsed answers; generate is a function of the three columns that gives the output column."""
    both = questions.select("query_id", "query").join(contexts, "query_id")
    return parsed_answers(both.select("query_id", generate(F.col("query"), F.col("context"), F.col("image_paths")).alias("output")))


# ------------------------------------------------------------------------------------------------ places on pages


def box_union(boxes: Column) -> Column:
    """The least box (x0, y0, x1, y1) around an array of boxes; null for none."""
    side = lambda f, c: f(F.transform(boxes, lambda b: b[c]))
    return F.when(F.size(boxes) > 0, F.struct(side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1")))


def located(sentences: DataFrame, pages: DataFrame, key: str = "paper_id") -> DataFrame:
    """sentences (node_id, key, page, text) on pages (key, page, words: array of word, x0, y0, x1, y1 in reading order) -> node_id, bbox, how.

    The first run of page words equal to the sentence's (how: exact) gives the box around them; else, from twelve words on, the
    first run equal to its fourth to twelfth word (part); else there is none. A page is looked at by itself, so its words bound a row.
    """
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    both = sentences.join(pages, [key, "page"]).withColumn("s", words).withColumn("w", F.transform("words", lambda x: x["word"]))

    def first(run: Column) -> Column:
        starts = F.when(F.size("w") >= F.size(run), F.sequence(F.lit(1), F.size("w") - F.size(run) + 1)).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(run) > 0, F.get(F.filter(starts, lambda i: (F.element_at("w", i) == F.element_at(run, 1)) & (F.slice("w", i, F.size(run)) == run)), F.lit(0)))

    middle = F.slice("s", 4, 9)
    both = both.withColumn("whole", first(F.col("s"))).withColumn("part", F.when(F.col("whole").isNull() & (F.size("s") >= 12), first(middle)))
    run = F.when(F.col("whole").isNotNull(), F.slice("words", F.col("whole"), F.size("s"))).when(F.col("part").isNotNull(), F.slice("words", F.col("part"), F.lit(9)))
    how = F.when(F.col("whole").isNotNull(), "exact").when(F.col("part").isNotNull(), "part")
    return both.withColumn("run", run).select("node_id", box_union(F.col("run")).alias("bbox"), how.alias("how"))
