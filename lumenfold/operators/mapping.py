"""Evidence texts to graph nodes: equal after normalisation, else the most similar above a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import best_ratios, normalized_evidence, sequence_ratio
from ..sources.scratch import Scratch
from .recall import searchable

#: Node types that evidence may be mapped to.
MAPPED = ("Sentence", "Table", "Caption", "ChartData")


#: Least quotient of two texts' numbers of words at which their Jaccard similarity is taken first.
ALIKE = 0.8


def jaccard(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (evidence_id, words) and nodes (node_id, words), words distinct -> evidence_id, node_id, jaccard of all pairs that share a word.

    Words meet by equality, so no pair without one in common is ever made; the shared ones are counted before the pairs move on.
    """
    left = asked.select("evidence_id", F.size("words").alias("a"), F.explode("words").alias("word"))
    right = nodes.select("node_id", F.size("words").alias("b"), F.explode("words").alias("word"))
    both = right.join(left, "word").groupBy("evidence_id", "node_id", "a", "b").agg(F.count("*").alias("n"))
    return both.select("evidence_id", "node_id", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("jaccard"))


def map_evidence(evidence: DataFrame, nodes: DataFrame, least: float = 0.85) -> DataFrame:
    """evidence (evidence_id, paper_id, evidence) -> evidence_id, node_id, score, method (exact, fuzzy, empty).

    An equal text of the paper scores 1 and the first such node (by `ord` if nodes have it, then id) is meant. Otherwise the
    score is the greatest of word-set Jaccard and sequence ratio over the paper's nodes, first node at ties; node_id is null below `least`.
    Equal texts of a paper are compared once. Numbers of words bound Jaccard from above; lengths, letters and longest common subsequences
    bound the ratio: only pairs that may reach a score already seen go to Python, and there the costly comparison is made for those whose
    bounds allow it.
    """
    scratch = Scratch(nodes.sparkSession, "mapping")
    order = F.col("ord") if "ord" in nodes.columns else F.lit(0)
    n = searchable(nodes).where(F.col("node_type").isin(list(MAPPED))).select("paper_id", "node_id", order.alias("o"), normalized_evidence("searchable_text").alias("t"))
    # texts are normalised once, for all that follows; the first node stands for those of an equal text, which are brought together before
    # they are dealt, to so many parts that all cores compare, however small the table is
    session = nodes.sparkSession
    parts = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    words = lambda c: F.array_distinct(F.split(F.col(c), " "))
    n = n.where("t <> ''").groupBy("paper_id", "t").agg(F.min(F.struct("o", "node_id")).alias("m"))
    n = scratch.write(n.select("paper_id", "t", "m.*", F.size(words("t")).alias("b")).repartition(parts))
    e = scratch.write(evidence.select("evidence_id", "paper_id", normalized_evidence(F.coalesce("evidence", F.lit(""))).alias("q")))
    seen = e.join(n.select("paper_id", F.col("t").alias("q"), F.col("node_id").alias("exact_id")), ["paper_id", "q"], "left")
    exact = seen.where("exact_id IS NOT NULL").select("evidence_id", F.col("exact_id").alias("node_id"), F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    empty = seen.where("q = ''").select("evidence_id", F.lit(None).cast("string").alias("node_id"), F.lit(0.0).alias("score"), F.lit("empty").alias("method"))
    rest = scratch.write(seen.where("q <> '' AND exact_id IS NULL").select("evidence_id", "paper_id", "q", F.size(words("q")).alias("a")))
    # the greatest score, the first node at ties
    led = lambda df, *more: df.groupBy("evidence_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "o", "node_id", *more)).alias("m")).select("evidence_id", (-F.col("m.s")).alias("score"), "m.o", "m.node_id", *[f"m.{c}" for c in more])
    both = F.size(F.array_intersect(words("q"), words("t")))
    jaccards = lambda pairs: pairs.select("evidence_id", "q", "o", "node_id", "t", (both / (F.col("a") + F.col("b") - both)).alias("score"))
    # numbers of words bound Jaccard: pairs of like numbers go first
    share = F.least("a", "b") / F.greatest("a", "b")
    similar = scratch.write(led(jaccards(n.join(rest, "paper_id").where(share >= ALIKE)), "q", "t"))
    # the best of a step has a ratio too; what can't reach the greater of the two is not compared in the next
    def reaching(best: DataFrame) -> DataFrame:
        floor = F.greatest("score", sequence_ratio("q", "t")).alias("floor")
        return scratch.write(rest.join(best.select("evidence_id", floor), "evidence_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))))

    further = jaccards(n.join(reaching(similar), "paper_id").where((share < ALIKE) & (share >= F.col("floor"))))
    similar = scratch.write(led(similar.unionByName(further), "q", "t"))
    asked = reaching(similar)
    bound = 2.0 * F.least(F.length("q"), F.length("t")) / (F.length("q") + F.length("t"))
    costly = n.join(asked, "paper_id").where(bound >= F.col("floor")).select("evidence_id", "q", "floor", "o", "node_id", "t")
    kind = ", ".join(f"{c} {t}" for c, t in (("evidence_id", dict(rest.dtypes)["evidence_id"]), ("score", "double"), ("o", dict(n.dtypes)["o"]), ("node_id", dict(n.dtypes)["node_id"])))
    top = led(similar.drop("q", "t").unionByName(costly.mapInArrow(best_ratios, kind))).select("evidence_id", F.struct("node_id", "score").alias("m"))
    fuzzy = rest.select("evidence_id").join(top, "evidence_id", "left").select(
        "evidence_id", F.when(F.col("m.score") >= least, F.col("m.node_id")).alias("node_id"), F.coalesce("m.score", F.lit(0.0)).alias("score"), F.lit("fuzzy").alias("method")
    )
    return exact.unionByName(empty).unionByName(fuzzy)
