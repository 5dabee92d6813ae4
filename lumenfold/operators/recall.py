"""Candidate recall for many queries at once: scoped BM25 and exact cosine, the best k of each node type.

A query may bring paper_ids and candidate_node_ids; an empty or null list is no filter, both together must hold. Statistics of BM25
are those of the query's scope and node type. Queries of equal scope share them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, l2_normalized, tokens
from ..sources.scratch import Scratch

#: Node types that are searched, in the order in which ties between types are broken.
TYPES = ("Sentence", "Figure", "Table", "Caption", "ChartData")
#: Scores are compared at so many digits, so that sums in another order break no ties.
DIGITS = 9


def type_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), c)


def searchable(nodes: DataFrame) -> DataFrame:
    """text, or the text view of a figure, or nothing."""
    view = F.col("text_view") if "text_view" in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumn("searchable_text", F.coalesce(F.nullif(F.col("text"), F.lit("")), view, F.lit("")))


def scoped(queries: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with scope, members (scope, node_id, ...)): each distinct pair of filters is one scope.

    Queries without filter columns share one scope, which is all nodes: then nothing is joined.
    """
    if not {"paper_ids", "candidate_node_ids"} & set(queries.columns):
        everything = F.lit("")
        return queries.withColumn("scope", everything), nodes.withColumn("scope", everything)
    none = F.array().cast("array<string>")
    lists = [F.array_sort(F.array_distinct(F.coalesce(F.col(c).cast("array<string>"), none))) if c in queries.columns else none for c in ("paper_ids", "candidate_node_ids")]
    q = queries.withColumns({"__papers": lists[0], "__cands": lists[1]}).withColumn("scope", F.sha1(F.to_json(F.struct("__papers", "__cands"))))
    scopes = q.select("scope", "__papers", "__cands").distinct()
    # one join by paper (a scope without filters takes part as every paper's, and as that of nodes without one), one by node
    by_node = scopes.where(F.size("__cands") > 0).select("scope", "__papers", F.explode("__cands").alias("__key"))
    fits = (F.size("__papers") == 0) | F.array_contains("__papers", F.col("paper_id"))
    named = scopes.where((F.size("__papers") > 0) & (F.size("__cands") == 0)).select("scope", F.explode("__papers").alias("__key")).where("__key IS NOT NULL")
    free = scopes.where((F.size("__papers") == 0) & (F.size("__cands") == 0)).select("scope")
    by_paper = named.unionByName(free.crossJoin(nodes.select(F.col("paper_id").alias("__key")).distinct()))  # at most one scope is free
    members = nodes.join(by_paper, F.col("paper_id").eqNullSafe(F.col("__key"))).drop("__key")
    if "candidate_node_ids" in queries.columns:
        members = members.unionByName(nodes.join(by_node, F.col("node_id") == F.col("__key")).where(fits).drop("__key", "__papers"))
    return q.drop("__papers", "__cands"), members


def best_per_type(scored: DataFrame, k: int, *ties: Column) -> DataFrame:
    """The k best of each (query_id, node_type), and their place among all of the query's."""
    by_type = Window.partitionBy("query_id", "node_type").orderBy(F.col("score").desc(), *ties)
    top = scored.withColumn("type_rank", F.row_number().over(by_type)).where(F.col("type_rank") <= k)
    overall = Window.partitionBy("query_id").orderBy(F.col("score").desc(), type_order(F.col("node_type")), "type_rank")
    return top.withColumn("pos", F.row_number().over(overall))


def bm25(queries: DataFrame, nodes: DataFrame, k: int = 25, types=TYPES, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """queries (query_id, query, ...) x nodes (node_id, paper_id, node_type, text, ...) -> query_id, node_id, paper_id, node_type, score, pos."""
    queries = queries.where("query_id IS NOT NULL")  # what has no id can't be answered
    scratch = Scratch(nodes.sparkSession, "bm25")
    text = searchable(nodes).where(F.col("node_type").isin(list(types)) & (F.trim("searchable_text") != ""))
    # the index: texts are split and tokenised once, for all queries; statistics read its lengths alone
    docs = scratch.write(text.select("node_id", "paper_id", "node_type", tokens(F.col("searchable_text")).alias("words")).withColumn("len", F.size("words")))
    q, members = scoped(queries, docs)
    terms = q.select("query_id", "scope", F.explode(tokens(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))
    asked = terms.select("scope", "term").distinct()
    stats = members.groupBy("scope", "node_type").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    # only terms that some query of the scope asks for become postings
    words = members.select("scope", "node_id", "paper_id", "node_type", "len", F.explode("words").alias("term")).join(asked, ["scope", "term"])
    postings = scratch.write(words.groupBy("scope", "node_type", "term", "node_id", "paper_id", "len").agg(F.count("*").alias("tf")))
    df = postings.groupBy("scope", "node_type", "term").agg(F.count("*").alias("df"))
    idf = df.join(stats, ["scope", "node_type"]).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("avg_len", F.lit(1.0))))
    parts = postings.join(idf, ["scope", "node_type", "term"]).select("scope", "node_type", "term", "node_id", "paper_id", weight.alias("w"))
    # blocks of nodes meet blocks of queries: scores are summed in a matrix there, and only each block's best rows move on
    nodes_blocks, query_blocks = -(-docs.count() // POSTED_NODES) or 1, -(-q.count() // POSTED_QUERIES) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides' block numbers are ints: a long is hashed to another partition than an equal int, and its block would meet nothing
    left = parts.withColumn("i", F.pmod(F.xxhash64("node_id"), F.lit(nodes_blocks)).cast("int")).select("*", each(query_blocks).alias("j"))
    right = terms.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).select("*", each(nodes_blocks).alias("i"))
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((terms, "query_id"), (parts, "node_id"), (parts, "paper_id"), (parts, "node_type"))) + ", score double"
    scored = left.groupBy("scope", "i", "j").cogroup(right.groupBy("scope", "i", "j")).applyInArrow(_summed_block(k, kind), kind)
    top = best_per_type(scored, k, F.col("node_id").desc())
    return top.select("query_id", "node_id", "paper_id", "node_type", "score", "pos")


#: Nodes and queries of one block of the score matrix: 32 MB.
POSTED_NODES, POSTED_QUERIES = 16_384, 256


def _summed_block(k: int, kind: str):
    """Of one block of weighted postings and one of query terms, each query's k best nodes of each type, ties by descending id."""
    names = [x.rsplit(" ", 1)[0] for x in kind.split(", ")]

    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        fields = [asked.schema.field("query_id"), *(posted.schema.field(c) for c in ("node_id", "paper_id", "node_type"))]
        out = [pa.schema([*fields, pa.field("score", pa.float64())]).empty_table()]
        if posted.num_rows and asked.num_rows:
            coded = posted.column("term").combine_chunks().dictionary_encode()
            term = coded.indices.to_numpy()
            wanted = pc.index_in(asked.column("term").combine_chunks(), value_set=coded.dictionary)
            met = np.flatnonzero(~wanted.is_null().to_numpy(zero_copy_only=False))
            q = asked.column("query_id").combine_chunks().dictionary_encode()
            q_at, q_term, q_weight = q.indices.to_numpy()[met], wanted.take(pa.array(met)).to_numpy(), asked.column("qtf").to_numpy()[met]
            # nodes in the order of ties, types side by side
            # a node is its id and its paper, either of which may be null
            pair = pc.binary_join_element_wise(*(posted.column(c).cast(pa.string()) for c in ("node_id", "paper_id")), "\x1f", null_handling="replace", null_replacement="\x00")
            node = pair.combine_chunks().dictionary_encode()
            n_at = node.indices.to_numpy()
            lead = np.zeros(len(node.dictionary), np.int64)
            lead[n_at[::-1]] = np.arange(len(n_at))[::-1]
            info = posted.select(["node_id", "paper_id", "node_type"]).take(pa.array(lead))
            order = pc.sort_indices(info, sort_keys=[("node_type", "ascending"), ("node_id", "descending")]).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            info, n_at, w = info.take(pa.array(order)), place[n_at], posted.column("w").to_numpy()
            key = term.astype(np.int64) * len(order) + n_at
            by = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) > 0)))
            w, n_at = np.add.reduceat(w[by], first), n_at[by[first]]  # texts of one node are summed
            bound = np.searchsorted(term[by[first]], np.arange(len(coded.dictionary) + 1))
            scores = np.zeros((len(q.dictionary), len(order)))
            by_q = np.argsort(q_term, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], np.diff(q_term[by_q]) > 0))) if len(met) else np.zeros(0, np.int64)
            for a, z in zip(heads, [*heads[1:], len(by_q)], strict=True):
                who, rows = by_q[a:z], slice(bound[q_term[by_q[a]]], bound[q_term[by_q[a]] + 1])
                for x in who.tolist():  # a query has a term once, a node too
                    scores[q_at[x], n_at[rows]] += q_weight[x] * w[rows]
            scores = np.round(scores, DIGITS)
            kinds = np.array(info.column("node_type").to_pylist())
            cut = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                best = np.argsort(-scores[:, i:j], axis=1, kind="stable")[:, :k] if j - i <= 4 * k else _leading(scores[:, i:j], k)
                at, who = (best + i).ravel(), np.repeat(np.arange(len(scores)), best.shape[1])
                good = scores[who, at] > 0
                at, who = at[good], who[good]
                out.append(pa.Table.from_arrays([q.dictionary.take(pa.array(who)), *(info.column(c).take(pa.array(at)) for c in ("node_id", "paper_id", "node_type")), pa.array(scores[who, at])], ["query_id", "node_id", "paper_id", "node_type", "score"]))
        return pa.concat_tables(out).select(names)

    return run


def _leading(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, equal ones in their order: only what reaches the k-th greatest is sorted."""
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for r, x in enumerate(scores):
        at = np.flatnonzero(x >= least[r])
        out[r] = at[np.argsort(-x[at], kind="stable")[:k]]
    return out


#: Rows and queries of one block of the exact product: 32 MB of vectors of 64 numbers.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 2_048


def _best_of_block(k: int, kind: str):
    """Of one block of rows and one of queries, each query's k best of each type, by one matrix product."""
    names = [x.rsplit(" ", 1)[0] for x in kind.split(", ")]

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = np.array(column.to_pylist(), np.float64)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [rows.schema.empty_table().select(["node_id", "paper_id", "node_type", "ord"]).append_column("query_id", pa.array([], asked.schema.field("query_id").type)).append_column("score", pa.array([], pa.float64()))]
        if rows.num_rows and asked.num_rows:
            # rows in the order of ties, types side by side: a stable sort by score then keeps that order
            rows = rows.sort_by([("node_type", "ascending"), ("ord", "ascending"), ("node_id", "ascending")])
            kinds = np.array(rows.column("node_type").to_pylist())
            cut = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
            scores = np.round(unit(asked.column("query_vector")) @ unit(rows.column("vector")).T, DIGITS)
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                best = np.argsort(-scores[:, i:j], axis=1, kind="stable")[:, :k] if j - i <= 4 * k else _leading(scores[:, i:j], k)
                at, who = (best + i).ravel(), np.repeat(np.arange(asked.num_rows), best.shape[1])
                part = rows.take(pa.array(at)).select(["node_id", "paper_id", "node_type", "ord"])
                out.append(part.append_column("query_id", asked.column("query_id").take(pa.array(who))).append_column("score", pa.array(scores[who, at])))
        return pa.concat_tables(out).select(names)

    return run


def _blocked_cosine(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """All rows against all queries: each block of rows meets each block of queries in one task of bounded memory, and only the best move on."""
    rows = rows.where("vector IS NOT NULL").select("node_id", "paper_id", "node_type", "ord", "vector")
    asked = queries.where("query_vector IS NOT NULL").select("query_id", "query_vector")
    n_rows, n_asked = -(-rows.count() // BLOCK_ROWS) or 1, -(-asked.count() // BLOCK_QUERIES) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides' block numbers are ints, as in bm25
    left = rows.withColumn("i", F.pmod(F.xxhash64("node_id"), F.lit(n_rows)).cast("int")).select("*", each(n_asked).alias("j"))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int")).select("*", each(n_rows).alias("i"))
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((asked, "query_id"), (rows, "node_id"), (rows, "paper_id"), (rows, "node_type"), (rows, "ord"))) + ", score double"
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_best_of_block(k, kind), kind)


def cosine(queries: DataFrame, vectors: DataFrame, k: int = 25, types=TYPES) -> DataFrame:
    """Exact cosine. queries (query_id, query_vector, ...), vectors (node_id, paper_id, node_type, vector, ord) in scope order.

    Every row that has a vector is scored against every query of its scope: block by block where queries bring no filters, by a join on
    the scope otherwise. Ties go by scope order: the candidates' ids, else papers and then `ord`, else `ord`.
    """
    rows = vectors.where(F.col("node_type").isin(list(types)))
    if not {"paper_ids", "candidate_node_ids"} & set(queries.columns):
        return best_per_type(_blocked_cosine(queries, rows, k), k, F.col("ord"), F.col("node_id")).select("query_id", "node_id", "paper_id", "node_type", "score", "pos")
    rows = rows.where("vector IS NOT NULL").withColumn("unit", l2_normalized(F.col("vector"))).drop("vector")
    q, members = scoped(queries, rows)
    none = F.array().cast("array<string>")
    has = lambda c: (F.size(F.coalesce(F.col(c), none)) > 0) if c in queries.columns else F.lit(False)
    asked = q.select("query_id", "scope", l2_normalized(F.col("query_vector")).alias("asked"), has("candidate_node_ids").alias("by_node"), has("paper_ids").alias("by_paper"))
    scored = members.join(asked, "scope").withColumn("score", F.round(dot(F.col("unit"), F.col("asked")), DIGITS))
    ties = (F.when(F.col("by_node"), F.col("node_id")), F.when(F.col("by_paper"), F.col("paper_id")), F.col("ord"), F.col("node_id"))
    return best_per_type(scored, k, *ties).select("query_id", "node_id", "paper_id", "node_type", "score", "pos")
