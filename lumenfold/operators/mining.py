"""Training-data mining over graphs: hard negatives, relation triples, typed node indexes, losses of given scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_place
from ..functions.text import dot

#: Relations that triples are drawn from.
RELATIONS = ("caption_of", "refers_to", "derived_from", "next_sentence")


#: Positives and pool nodes of one block of likenesses: 64 MB.
BLOCK_POSITIVES, BLOCK_POOL = 512, 16_384


def _most_alike():
    """Of one block of a query's positives and one of its pool, each positive's most alike pool node of its own type and of the other types, least id at ties."""

    def matrix(column) -> np.ndarray:
        return np.array(column.to_pylist(), np.float64)

    def run(positives: pa.Table, pool: pa.Table) -> pa.Table:
        out = {"query_id": [], "positive": [], "node_id": [], "other": [], "like": []}
        if positives.num_rows and pool.num_rows:
            pool = pool.sort_by("node_id")
            like = np.full((positives.num_rows, pool.num_rows), -1.0)
            known = np.flatnonzero(pool.column("vector").is_valid().to_numpy())
            if len(known):
                like[:, known] = np.round(matrix(positives.column("p_vector")) @ matrix(pool.column("vector").take(pa.array(known))).T, 9)
            kinds, ids = np.array(pool.column("node_type").to_pylist()), pool.column("node_id").to_pylist()
            names, asked = positives.column("positive").to_pylist(), positives.column("query_id").to_pylist()
            for i, t in enumerate(positives.column("p_type").to_pylist()):
                for other in (False, True):
                    at = np.flatnonzero((kinds != t) == other)
                    if len(at):
                        best = at[np.argmax(like[i, at])]
                        for c, v in zip(out, (asked[i], names[i], ids[best], other, float(like[i, best])), strict=True):
                            out[c].append(v)
        types = [positives.schema.field("query_id").type, positives.schema.field("positive").type, pool.schema.field("node_id").type, pa.bool_(), pa.float64()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    return run


def hard_negatives(positives: DataFrame, pool: DataFrame, vectors: DataFrame, seed: int = 42) -> DataFrame:
    """For each positive (query_id, node_id) the pool node (query_id, node_id) most like it.

    Nodes of the positive's type are preferred as long as there are any; gold of the query is never a negative. Likeness is
    the dot product (-1 for a pool node without vector), ties by id. A positive without vector takes the pool node of least
    seeded hash. vectors: node_id, node_type, vector (null where there is none). A query's positives meet its pool block by block.
    """
    v = vectors.select("node_id", "node_type", "vector")
    gold = positives.select("query_id", "node_id").distinct()
    p = gold.join(v, "node_id").select("query_id", F.col("node_id").alias("positive"), F.col("node_type").alias("p_type"), F.col("vector").alias("p_vector"))
    others = pool.select("query_id", "node_id").distinct().join(gold, ["query_id", "node_id"], "left_anti").join(v, "node_id").select("query_id", "node_id", "node_type", "vector")
    # blocks by the largest pool and the most positives of a query
    most = lambda df: df.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
    n_pool, n_positives = -(-most(others) // BLOCK_POOL), -(-most(gold) // BLOCK_POSITIVES)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides' block numbers are ints: a long is hashed to another partition than an equal int, and its block would meet nothing
    left = p.where("p_vector IS NOT NULL").withColumn("i", F.pmod(F.xxhash64("positive"), F.lit(n_positives)).cast("int")).select("*", each(n_pool).alias("j"))
    right = others.withColumn("j", F.pmod(F.xxhash64("node_id"), F.lit(n_pool)).cast("int")).select("*", each(n_positives).alias("i"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # new identities: both sides come from the same vectors
    kind = f"query_id {gold.schema['query_id'].dataType.simpleString()}, positive {gold.schema['node_id'].dataType.simpleString()}, node_id {gold.schema['node_id'].dataType.simpleString()}, other boolean, like double"
    met = left.groupBy("query_id", "i", "j").cogroup(right.groupBy("query_id", "i", "j")).applyInArrow(_most_alike(), kind)
    best = met.groupBy("query_id", "positive").agg(F.min(F.struct("other", (-F.col("like")).alias("l"), "node_id"))["node_id"].alias("negative"))
    pick = F.sha1(F.concat_ws("|", F.lit(str(seed)), "positive", "node_id"))
    drawn = p.where("p_vector IS NULL").join(others, "query_id").groupBy("query_id", "positive").agg(F.min(F.struct((F.col("node_type") != F.col("p_type")).alias("o"), pick.alias("h"), "node_id"))["node_id"].alias("negative"))
    return best.unionByName(drawn).select("query_id", F.col("positive").alias("positive_node_id"), F.col("negative").alias("negative_node_id"))


def relation_triples(nodes: DataFrame, edges: DataFrame, train_papers: DataFrame, seed: int = 42, relations=RELATIONS) -> DataFrame:
    """(src, dst, negative) for edges out of training papers: a node of the source's paper and the target's type that no kept edge leads to from the source.

    A paper's nodes of one type stand in a circle, in the order of a seeded hash; an edge's hash says where to begin, and the first free node from there is
    drawn. One more place is looked at than the source has neighbours of that type, so work grows with the edges, not with a paper's pairs.
    """
    h = lambda *c: F.sha1(F.concat_ws("|", F.lit(str(seed)), *c))
    n = nodes.join(train_papers.select("paper_id").distinct(), "paper_id", "left_semi").select("node_id", "paper_id", "node_type")
    types = nodes.select(F.col("node_id").alias("dst"), F.col("node_type").alias("d_type"))
    kept = edges.where(F.col("relation").isin(list(relations))).join(n.select(F.col("node_id").alias("src"), "paper_id", F.col("node_type").alias("s_type")), "src").select("src", "dst", "paper_id", "s_type").distinct().join(types, "dst")
    circle = n.withColumn("place", F.row_number().over(Window.partitionBy("paper_id", "node_type").orderBy(h("node_id"), "node_id")) - 1)
    size = n.groupBy("paper_id", F.col("node_type").alias("d_type")).agg(F.count("*").alias("size"))
    taken = kept.groupBy("src", "d_type").agg(F.collect_set("dst").alias("taken"))
    asked = kept.join(taken, ["src", "d_type"]).join(size, ["paper_id", "d_type"])
    looks = F.least(F.col("size"), F.size("taken") + 1 + (F.col("s_type") == F.col("d_type")).cast("int"))
    begin = F.conv(F.substring(h("src", "dst"), 1, 8), 16, 10).cast("long")
    tries = asked.select("src", "dst", "paper_id", "d_type", "taken", "size", F.posexplode(F.transform(F.sequence(F.lit(0), looks.cast("int") - 1), lambda i: (begin + i) % F.col("size"))).alias("turn", "place"))
    found = tries.join(circle.withColumnRenamed("node_type", "d_type"), ["paper_id", "d_type", "place"]).where((F.col("node_id") != F.col("src")) & ~F.array_contains("taken", F.col("node_id")))
    return found.groupBy("src", "dst").agg(F.min_by("node_id", "turn").alias("negative"))


def typed_index(nodes: DataFrame) -> DataFrame:
    """node_id, node_type and its place (from 0) among nodes of its type by id.

    Places are counted within ranges of ids and shifted by the ranges before, so a type that holds most nodes is no single task.
    """
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 2)
    # a bound from each of n hash classes, drawn by a second hash
    least = nodes.groupBy(F.pmod(F.xxhash64("node_id"), F.lit(n)).alias("h")).agg(F.max_by("node_id", F.sha1("node_id")).alias("i"))
    bounds = sorted(r["i"] for r in least.collect())
    ranged = nodes.select("node_id", "node_type")
    ranged = ranged.withColumn("cell", range_place(F.col("node_id"), bounds))
    counts = ranged.groupBy("node_type", "cell").count()
    before = counts.select("node_type", "cell", (F.sum("count").over(Window.partitionBy("node_type").orderBy("cell")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("node_type", "cell").orderBy("node_id")) - 1
    return ranged.withColumn("__p", place).join(before, ["node_type", "cell"]).select("node_id", "node_type", (F.col("before") + F.col("__p")).cast("long").alias("index"))


def typed_edges(edges: DataFrame) -> DataFrame:
    """Edges with their reverses, the latter's relation marked."""
    return edges.select("src", "dst", "relation").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("rev_"), F.col("relation")).alias("relation")))


def info_nce(scores: DataFrame, temperature: float = 0.07) -> DataFrame:
    """scores (query_id, score, positive) -> query_id, loss: the positive's share of the query's softmax, as negative logarithm."""
    e = F.exp(F.col("score") / temperature)
    return scores.groupBy("query_id").agg((-F.log(F.sum(F.when(F.col("positive"), e).otherwise(0.0)) / F.sum(e))).alias("loss"))


def margin_loss(pairs: DataFrame, margin: float = 0.2) -> DataFrame:
    """pairs (positive_score, negative_score) -> the mean shortfall from the margin."""
    return pairs.agg(F.avg(F.greatest(F.lit(0.0), margin - F.col("positive_score") + F.col("negative_score"))).alias("loss"))
