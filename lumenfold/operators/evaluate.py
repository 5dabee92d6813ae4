"""Evaluation for many queries at once: rankings (query_id, node_id, pos), selections and gold (query_id, node_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import lcs_length
from ..functions.text import normalized_answer, words_of_answer
from .recall import TYPES


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))


def share(top: Column, under: Column) -> Column:
    return F.when(under > 0, top / under).otherwise(F.lit(0.0))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, cutoffs=(1, 3, 5, 10)) -> DataFrame:
    """By query: recall, joint recall and nDCG at each cutoff, reciprocal rank of the first gold, and within ten."""
    cutoffs = sorted(set(cutoffs))
    if not cutoffs:
        raise ValueError("at least one cutoff is needed")
    g = gold.select("query_id", "node_id").distinct()
    size = g.groupBy("query_id").agg(F.count("*").alias("n"))
    found = g.join(ranked.select("query_id", "node_id", "pos"), ["query_id", "node_id"])
    aggs = [F.min("pos").alias("first")]
    for k in cutoffs:
        inside = F.col("pos") <= k
        aggs += [F.count_if(inside).alias(f"hit_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("pos") + 1)).otherwise(0.0)).alias(f"dcg_{k}")]
    rows = size.join(found.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = [F.col("query_id")]
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
        got = F.coalesce(f"hit_{k}", F.lit(0))
        out += [
            (got / F.col("n")).alias(f"recall_at_{k}"),
            F.round(F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal, 9).alias(f"ndcg_at_{k}"),
            (got == F.col("n")).cast("double").alias(f"joint_recall_at_{k}"),
        ]
    first = F.col("first")
    out += [F.coalesce(1 / first, F.lit(0.0)).alias("mrr"), F.when(first <= 10, 1 / first).otherwise(F.lit(0.0)).alias("mrr_at_10")]
    return rows.select(*out)


def evidence_metrics(selected: DataFrame, gold: DataFrame, prefix: str = "evidence") -> DataFrame:
    """By query of gold: precision, recall and F1 of the selected nodes (also for cited against gold, with another prefix)."""
    s = selected.select("query_id", "node_id").distinct().withColumn("s", F.lit(1))
    g = gold.select("query_id", "node_id").distinct().withColumn("g", F.lit(1))
    rows = g.join(s, ["query_id", "node_id"], "full").groupBy("query_id").agg(F.count("g").alias("ng"), F.count("s").alias("ns"), F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("both"))
    p, r = share(F.col("both"), F.col("ns")), share(F.col("both"), F.col("ng"))
    return rows.where("ng > 0").select("query_id", p.alias(f"{prefix}_precision"), r.alias(f"{prefix}_recall"), harmonic(p, r).alias(f"{prefix}_f1"))


def typed_metrics(ranked: DataFrame, selected: DataFrame, gold: DataFrame, nodes: DataFrame, cutoffs=(1, 3, 5, 10), types=TYPES) -> DataFrame:
    """By query and node type: recall at each cutoff and evidence precision, recall, F1; null where the type has no gold."""
    kind = nodes.select("node_id", "node_type")
    g = gold.select("query_id", "node_id").distinct().join(kind, "node_id").withColumn("g", F.lit(1))
    s = selected.select("query_id", "node_id").distinct().join(kind, "node_id").withColumn("s", F.lit(1))
    both = g.join(s, ["query_id", "node_type", "node_id"], "full").join(ranked.select("query_id", "node_id", "pos"), ["query_id", "node_id"], "left")
    hits = [F.count_if(F.col("g").isNotNull() & (F.col("pos") <= k)).alias(f"hit_{k}") for k in sorted(set(cutoffs))]
    rows = both.groupBy("query_id", "node_type").agg(F.count("g").alias("ng"), F.count("s").alias("ns"), F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("tp"), *hits)
    asked = gold.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(t) for t in types])).alias("node_type"))
    full = asked.join(rows, ["query_id", "node_type"], "left")
    known = F.coalesce("ng", F.lit(0)) > 0
    p, r = share(F.col("tp"), F.col("ns")), F.col("tp") / F.col("ng")
    return full.select(
        "query_id", "node_type", *[F.when(known, F.col(f"hit_{k}") / F.col("ng")).alias(f"recall_at_{k}") for k in sorted(set(cutoffs))],
        F.when(known, p).alias("evidence_precision"), F.when(known, r).alias("evidence_recall"), F.when(known, harmonic(p, r)).alias("evidence_f1"),
    )


def micro_metrics(selected: DataFrame, gold: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pooled over all (query, node) pairs: precision, recall and F1 overall (node_type null) and by type."""
    s = selected.select("query_id", "node_id").distinct().withColumn("s", F.lit(1))
    g = gold.select("query_id", "node_id").distinct().withColumn("g", F.lit(1))
    rows = g.join(s, ["query_id", "node_id"], "full").join(nodes.select("node_id", "node_type"), "node_id")
    sums = rows.groupingSets([[], ["node_type"]], "node_type").agg(F.count("g").alias("ng"), F.count("s").alias("ns"), F.count_if(F.col("g").isNotNull() & F.col("s").isNotNull()).alias("tp"))
    p, r = share(F.col("tp"), F.col("ns")), share(F.col("tp"), F.col("ng"))
    return sums.select("node_type", p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"))


def macro_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metric, mean) of every numeric column but the keys, over the rows where it is not null."""
    by = by or []
    names = [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c != "query_id" and c not in by]
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(f"macro_{c}").alias("metric"), F.col(c).cast("double").alias("x")) for c in names])).alias("m")).select(*by, "m.*")
    return long.where(F.col("x").isNotNull()).groupBy(*by, "metric").agg(F.round(F.avg("x"), 9).alias("mean"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers (..., prediction, reference) with exact match, token F1 and ROUGE-L F1."""
    a = answers.withColumns({"__p": words_of_answer(F.col("prediction")), "__r": words_of_answer(F.col("reference"))})
    counts = F.array_distinct("__p")
    n = lambda c, w: F.size(F.filter(c, lambda x: x == w))
    overlap = F.aggregate(counts, F.lit(0), lambda s, w: s + F.least(n(F.col("__p"), w), n(F.col("__r"), w)))
    a = a.withColumn("__o", overlap).withColumn("__l", lcs_length("__p", "__r"))
    sp, sr = F.size("__p"), F.size("__r")
    return a.select(
        *answers.columns,
        (normalized_answer(F.col("prediction")) == normalized_answer(F.col("reference"))).cast("double").alias("exact_match"),
        harmonic(share(F.col("__o"), sp), share(F.col("__o"), sr)).alias("token_f1"),
        harmonic(share(F.col("__l"), sp), share(F.col("__l"), sr)).alias("rouge_l_f1"),
    )


def token_f1(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Token F1 of long answers by multiset intersection: words are counted by key and side, and the lesser counts summed."""
    words = lambda c: answers.select(*keys, F.explode(words_of_answer(F.col(c))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias(c))
    both = words("prediction").join(words("reference"), [*keys, "w"], "full").groupBy(*keys).agg(
        F.sum(F.coalesce("prediction", F.lit(0))).alias("p"), F.sum(F.coalesce("reference", F.lit(0))).alias("r"), F.sum(F.coalesce(F.least(F.when(F.col("reference").isNotNull(), F.col("prediction")), F.when(F.col("prediction").isNotNull(), F.col("reference"))), F.lit(0))).alias("o")
    )
    f = harmonic(share(F.col("o"), F.col("p")), share(F.col("o"), F.col("r")))
    return answers.select(*keys).distinct().join(both, keys, "left").select(*keys, F.coalesce(f, F.lit(0.0)).alias("token_f1"))


def comparison(reports: DataFrame, metrics: list[str]) -> DataFrame:
    """reports (run, metric, value) as one row a run and one column a metric."""
    return reports.groupBy("run").pivot("metric", metrics).agg(F.first("value"))


def unknown_citations(cited: DataFrame, forest: DataFrame) -> DataFrame:
    """Citations (query_id, node_id) outside the query's forest."""
    return cited.join(forest.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_anti")
