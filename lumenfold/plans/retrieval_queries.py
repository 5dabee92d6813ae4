"""Registered queries on text and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, fusion, mapping, recall, reports
from . import projections as P
from .oracle import SENTENCES, VECTORS, answer_words, cte, token_cost, tokens

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_BM25 = """
node AS (SELECT node_id, paper_id, @TOK@ AS w FROM sentence WHERE trim(text) <> ''),
word AS (SELECT n.node_id, n.paper_id, len(n.w) AS len, unnest(n.w) AS term FROM node n),
tf AS (SELECT node_id, paper_id, term, len, count(*) AS tf FROM word GROUP BY ALL),
scope AS (SELECT q.query_id, n.node_id, len(n.w) AS len FROM q JOIN node n ON len(q.papers) = 0 OR list_contains(q.papers, n.paper_id)),
stat AS (SELECT query_id, count(*) AS n, avg(len) AS al FROM scope GROUP BY 1),
qt AS (SELECT query_id, papers, term, count(*) AS qtf FROM (SELECT query_id, papers, unnest(@QTOK@) AS term FROM q) GROUP BY ALL),
m AS (SELECT qt.query_id, qt.qtf, tf.* FROM qt JOIN tf ON qt.term = tf.term AND (len(papers) = 0 OR list_contains(papers, tf.paper_id))),
df AS (SELECT query_id, term, count(*) AS df FROM m GROUP BY 1, 2),
s AS (SELECT m.query_id, m.node_id, m.paper_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(al, 1)))), 9) AS score
      FROM m JOIN df USING (query_id, term) JOIN stat USING (query_id) GROUP BY 1, 2, 3)
SELECT query_id, node_id, paper_id, score, pos FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id DESC))::INTEGER AS pos FROM s WHERE score > 0) WHERE pos <= 25
""".replace("@TOK@", tokens("text")).replace("@QTOK@", tokens("query"))
_COLS = ("query_id", "node_id", "paper_id", "score", "pos")


@query("bm25_topk", cte(SENTENCES, "q AS (SELECT item_id AS query_id, text AS query, []::VARCHAR[] AS papers FROM benchmark)", _BM25))
def bm25_topk(spark, sf):
    asked = P.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return recall.bm25(asked, P.sentences(P.table(spark, sf, "documents"))).select(*_COLS)


@query(
    "bm25_scoped",
    cte(SENTENCES, "q AS (SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 4 = 0 THEN []::VARCHAR[] ELSE ['src' || (item_id % 20), 'src' || (item_id % 7)] END AS papers FROM benchmark)", _BM25),
)
def bm25_scoped(spark, sf):
    i = F.col("item_id")
    papers = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), (i % 20).cast("string")), F.concat(F.lit("src"), (i % 7).cast("string"))))
    asked = P.table(spark, sf, "benchmark").select(i.alias("query_id"), F.col("text").alias("query"), papers.alias("paper_ids"))
    return recall.bm25(asked, P.sentences(P.table(spark, sf, "documents"))).select(*_COLS)


@query("tokenize_counts", f"SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)")
def tokenize_counts(spark, sf):
    t = P.table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("token_cost", f"SELECT doc_id, {token_cost('text')} AS cost FROM documents")
def token_cost_query(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", T.token_cost(F.col("text")).alias("cost"))


@query("split_sentences", cte(SENTENCES) + "SELECT node_id, ord, text FROM sentence")
def split_sentences(spark, sf):
    return P.sentences(P.table(spark, sf, "documents")).select("node_id", "ord", "text")


#: The texts of projections.label_texts, and the distinct labels in them.
_LABELLED = "t AS (SELECT l_orderkey, l_linenumber, l_partkey, 'As in Fig. ' || l_orderkey || 'b and figure ' || l_linenumber || ', FIG.' || l_orderkey || 'B; Figs. 3 or Table ' || l_linenumber || ', Tab. ' || l_orderkey || 'A, 表 ' || l_linenumber || '.' AS t FROM lineitem)"
_LABELS = "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '@', 1), lambda x: lower(x)))), ' ') AS labels FROM t"


@query("figure_labels", cte(_LABELLED) + _LABELS.replace("@", r"(?i)\bfig(?:ure)?\.?\s*(\d+[a-z]?)"))
def figure_labels(spark, sf):
    return P.label_texts(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.array_sort(T.figure_labels(F.col("t"))), " ").alias("labels"))


@query("table_labels", cte(_LABELLED) + _LABELS.replace("@", r"(?i)(?:\btab(?:le)?\.?\s*|表\s*)(\d+[a-z]?)"))
def table_labels(spark, sf):
    return P.label_texts(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.array_sort(T.table_labels(F.col("t"))), " ").alias("labels"))


@query("cosine_topk_per_type", cte(VECTORS) + "SELECT query_id, node_id, paper_id, node_type, score, pos FROM recalled")
def cosine_topk(spark, sf):
    e = P.table(spark, sf, "embeddings")
    return recall.cosine(P.vector_queries(e), P.vectors(e))


@query(
    "cosine_scoped",
    cte(VECTORS.replace("JOIN vec v ON q.ord % 50 = 0", "JOIN vec v ON q.ord % 50 = 0 AND v.paper_id IN ((q.ord % 20)::VARCHAR, '3')").replace("ORDER BY score DESC, ord)", "ORDER BY score DESC, paper_id, ord)"))
    + "SELECT query_id, node_id, paper_id, node_type, score, pos FROM recalled",
)
def cosine_scoped(spark, sf):
    e = P.table(spark, sf, "embeddings")
    asked = P.vector_queries(e).withColumn("paper_ids", F.array((F.col("query_id") % 20).cast("string"), F.lit("3")))
    return recall.cosine(asked, P.vectors(e))


@query("l2_normalize", "SELECT vec_id, list_transform(list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)), lambda x: round(x, 9)) AS unit FROM embeddings")
def l2_normalize(spark, sf):
    return P.table(spark, sf, "embeddings").select("vec_id", F.transform(T.l2_normalized(F.col("embedding")), lambda x: F.round(x, 9)).alias("unit"))


#: A second scorer that is silent about some hits.
_SECOND = "CASE WHEN ord % 3 = 0 THEN NULL ELSE ((ord * 7919) % 1000)::DOUBLE END"


@query(
    "rrf_fusion",
    cte(VECTORS, f"two AS (SELECT query_id, node_id, pos, score AS embedding, {_SECOND} AS graph FROM recalled)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY embedding DESC, pos) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(graph, -1e9) DESC, pos) AS r2 FROM two)")
    + "SELECT query_id, node_id, round(1 / (60 + r1) + 1 / (60 + r2), 12) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (60 + r1) + 1 / (60 + r2), 12) DESC, pos))::INTEGER AS pos FROM ranked",
)
def rrf_fusion(spark, sf):
    hits = _recalled(spark, sf)
    second = F.when(F.col("ord") % 3 == 0, F.lit(None)).otherwise(((F.col("ord") * 7919) % 1000).cast("double"))
    hits = hits.select("query_id", "node_id", "pos", F.col("score").alias("embedding"), second.alias("graph"))
    return fusion.fused(hits, ["embedding", "graph"]).select("query_id", "node_id", "score", "pos")


def _recalled(spark, sf):
    e = P.table(spark, sf, "embeddings")
    return recall.cosine(P.vector_queries(e), P.vectors(e)).withColumn("ord", F.col("node_id").cast("long"))


@query(
    "rrf_weighted_library",
    cte(VECTORS, "r AS (SELECT query_id, node_id, 'a' AS scorer, pos AS rank FROM recalled UNION ALL SELECT query_id, node_id, 'b', 126 - pos FROM recalled WHERE pos % 2 = 0)")
    + "SELECT query_id, node_id, round(sum(CASE scorer WHEN 'a' THEN 1.0 ELSE 0.5 END / (60 + rank)), 12) AS score FROM r GROUP BY ALL",
)
def rrf_weighted(spark, sf):
    hits = _recalled(spark, sf)
    a = hits.select("query_id", "node_id", F.lit("a").alias("scorer"), F.col("pos").alias("rank"))
    b = hits.where("pos % 2 = 0").select("query_id", "node_id", F.lit("b").alias("scorer"), (126 - F.col("pos")).alias("rank"))
    return fusion.reciprocal_rank_fusion(a.unionByName(b), weights={"b": 0.5})


@query(
    "score_calibration",
    cte(VECTORS, f"s AS (SELECT query_id, node_id, node_type, 'embedding' AS scorer, score AS value FROM recalled UNION ALL SELECT query_id, node_id, node_type, 'graph', {_SECOND} FROM recalled WHERE ord % 3 <> 0)",
        "st AS (SELECT node_type, scorer, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM s GROUP BY 1, 2)",
        "z AS (SELECT query_id, node_id, scorer, CASE WHEN n < 2 THEN value ELSE (value - mean) / greatest(sd, 1e-6) END AS z FROM s JOIN st USING (node_type, scorer))")
    + "SELECT query_id, node_id, round(sum(CASE scorer WHEN 'embedding' THEN 0.7 WHEN 'graph' THEN 0.3 ELSE 0 END * z), 6) AS score FROM z GROUP BY 1, 2",
)
def score_calibration(spark, sf):
    hits = _recalled(spark, sf)
    a = hits.select("query_id", "node_id", "node_type", F.lit("embedding").alias("scorer"), F.col("score").alias("value"))
    b = hits.where("ord % 3 <> 0").select("query_id", "node_id", "node_type", F.lit("graph").alias("scorer"), ((F.col("ord") * 7919) % 1000).cast("double").alias("value"))
    both = a.unionByName(b)
    out = fusion.weighted(fusion.calibrated(both, fusion.calibration(both)), {"embedding": 0.7, "graph": 0.3})
    return out.withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------------------------------------ metrics over recalled vectors

_GOLD = "gold AS (SELECT query_id, node_id, node_type FROM sim WHERE label = asked)"
_PICK = "pick AS (SELECT query_id, node_id, node_type FROM recalled WHERE pos <= 10)"
_CUTS = (1, 3, 5, 10)


def _judged(spark, sf):
    e = P.table(spark, sf, "embeddings")
    ranked = _recalled(spark, sf)
    nodes = P.vectors(e).select("node_id", "node_type", "label")
    asked = P.vector_queries(e).select("query_id", "label")
    return ranked, asked.join(nodes, "label").select("query_id", "node_id"), nodes


def _ranking_sql() -> str:
    out = []
    for k in _CUTS:
        ideal = f"list_sum(list_transform(range(1, least(n, {k}) + 1), lambda r: 1 / log2(r + 1)))"
        out.append(f"coalesce(h{k}, 0) / n AS recall_at_{k}, round(coalesce(d{k}, 0) / {ideal}, 9) AS ndcg_at_{k}, (coalesce(h{k}, 0) = n)::INTEGER::DOUBLE AS joint_recall_at_{k}")
    sums = ", ".join(f"count(*) FILTER (pos <= {k}) AS h{k}, sum(CASE WHEN pos <= {k} THEN 1 / log2(pos + 1) ELSE 0 END) AS d{k}" for k in _CUTS)
    return cte(VECTORS, _GOLD, "n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1)", f"f AS (SELECT query_id, min(pos) AS first, {sums} FROM gold JOIN recalled USING (query_id, node_id) GROUP BY 1)",
        f"rank_rows AS (SELECT query_id, {', '.join(out)}, coalesce(1 / first, 0) AS mrr, CASE WHEN first <= 10 THEN 1 / first ELSE 0 END AS mrr_at_10 FROM n LEFT JOIN f USING (query_id))")


@query("ranking_metrics", _ranking_sql() + "SELECT * FROM rank_rows")
def ranking_metrics(spark, sf):
    ranked, gold, _ = _judged(spark, sf)
    return evaluate.ranking_metrics(ranked, gold, _CUTS)


@query("macro_summary", _ranking_sql() + "SELECT 'macro_' || name AS metric, round(avg(value), 9) AS mean FROM (UNPIVOT rank_rows ON COLUMNS(* EXCLUDE (query_id))) GROUP BY 1")
def macro_summary(spark, sf):
    return evaluate.macro_summary(ranking_metrics(spark, sf))


_HARMONIC = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


@query(
    "evidence_prf",
    cte(VECTORS, _GOLD, _PICK, "c AS (SELECT query_id, count(g.node_id) AS ng, count(s.node_id) AS ns, count(*) FILTER (g.node_id IS NOT NULL AND s.node_id IS NOT NULL) AS tp FROM gold g FULL JOIN pick s USING (query_id, node_id) GROUP BY 1)",
        "x AS (SELECT query_id, CASE WHEN ns > 0 THEN tp / ns ELSE 0 END AS p, tp / ng AS r FROM c WHERE ng > 0)")
    + f"SELECT query_id, p AS evidence_precision, r AS evidence_recall, {_HARMONIC} AS evidence_f1 FROM x",
)
def evidence_prf(spark, sf):
    ranked, gold, _ = _judged(spark, sf)
    return evaluate.evidence_metrics(ranked.where("pos <= 10"), gold)


@query(
    "citation_prf",
    cte(VECTORS, _GOLD, "pick AS (SELECT query_id, node_id FROM recalled WHERE pos IN (1, 4, 9))", "c AS (SELECT query_id, count(g.node_id) AS ng, count(s.node_id) AS ns, count(*) FILTER (g.node_id IS NOT NULL AND s.node_id IS NOT NULL) AS tp FROM gold g FULL JOIN pick s USING (query_id, node_id) GROUP BY 1)",
        "x AS (SELECT query_id, CASE WHEN ns > 0 THEN tp / ns ELSE 0 END AS p, tp / ng AS r FROM c WHERE ng > 0)")
    + f"SELECT query_id, p AS citation_precision, r AS citation_recall, {_HARMONIC} AS citation_f1 FROM x",
)
def citation_prf(spark, sf):
    ranked, gold, _ = _judged(spark, sf)
    return evaluate.evidence_metrics(ranked.where("pos IN (1, 4, 9)"), gold, "citation")


@query(
    "per_type_recall",
    cte(VECTORS, _GOLD, _PICK,
        "b AS (SELECT coalesce(g.query_id, s.query_id) AS query_id, coalesce(g.node_type, s.node_type) AS node_type, coalesce(g.node_id, s.node_id) AS node_id, g.node_id IS NOT NULL AS g, s.node_id IS NOT NULL AS s FROM gold g FULL JOIN pick s ON g.query_id = s.query_id AND g.node_id = s.node_id)",
        "c AS (SELECT b.query_id, b.node_type, count(*) FILTER (g) AS ng, count(*) FILTER (s) AS ns, count(*) FILTER (g AND s) AS tp, " + ", ".join(f"count(*) FILTER (g AND pos <= {k}) AS h{k}" for k in _CUTS) + " FROM b LEFT JOIN recalled r ON r.query_id = b.query_id AND r.node_id = b.node_id GROUP BY 1, 2)",
        "x AS (SELECT q.query_id, t.node_type, ng, " + ", ".join(f"CASE WHEN ng > 0 THEN h{k} / ng END AS recall_at_{k}" for k in _CUTS) + ", CASE WHEN ng > 0 THEN CASE WHEN ns > 0 THEN tp / ns ELSE 0 END END AS p, CASE WHEN ng > 0 THEN tp / ng END AS r FROM (SELECT DISTINCT query_id FROM gold) q CROSS JOIN (SELECT unnest(['Sentence', 'Figure', 'Table', 'Caption', 'ChartData']) AS node_type) t LEFT JOIN c USING (query_id, node_type))")
    + "SELECT query_id, node_type, " + ", ".join(f"recall_at_{k}" for k in _CUTS) + f", p AS evidence_precision, r AS evidence_recall, CASE WHEN ng > 0 THEN {_HARMONIC} END AS evidence_f1 FROM x",
)
def per_type_recall(spark, sf):
    ranked, gold, nodes = _judged(spark, sf)
    return evaluate.typed_metrics(ranked, ranked.where("pos <= 10"), gold, nodes, _CUTS)


@query(
    "micro_metrics",
    cte(VECTORS, _GOLD, _PICK, "b AS (SELECT coalesce(g.node_type, s.node_type) AS node_type, g.node_id IS NOT NULL AS g, s.node_id IS NOT NULL AS s FROM gold g FULL JOIN pick s ON g.query_id = s.query_id AND g.node_id = s.node_id)",
        "c AS (SELECT node_type, count(*) FILTER (g) AS ng, count(*) FILTER (s) AS ns, count(*) FILTER (g AND s) AS tp FROM b GROUP BY GROUPING SETS ((), (node_type)))",
        "x AS (SELECT node_type, CASE WHEN ns > 0 THEN tp / ns ELSE 0 END AS p, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS r FROM c)")
    + f'SELECT node_type, p AS "precision", r AS recall, {_HARMONIC} AS f1 FROM x',
)
def micro_metrics(spark, sf):
    ranked, gold, nodes = _judged(spark, sf)
    return evaluate.micro_metrics(ranked.where("pos <= 10"), gold, nodes)


# ------------------------------------------------------------------------------------------------ answers over conversations

_ANSWERS = f"""
a AS (SELECT conv_id, turn, {answer_words("text")} AS p, {answer_words("nxt")} AS r FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)
"""


def _answers(spark, sf):
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return P.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prediction"), nxt.alias("reference")).where("reference IS NOT NULL")


@query(
    "answer_token_f1",
    cte(_ANSWERS, "pw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM a) GROUP BY ALL)", "rw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS w FROM a) GROUP BY ALL)",
        "o AS (SELECT conv_id, turn, sum(least(pw.n, rw.n)) AS o FROM pw JOIN rw USING (conv_id, turn, w) GROUP BY 1, 2)",
        "x AS (SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN coalesce(o, 0) / len(p) ELSE 0 END AS p, CASE WHEN len(r) > 0 THEN coalesce(o, 0) / len(r) ELSE 0 END AS r FROM a LEFT JOIN o USING (conv_id, turn))")
    + f"SELECT conv_id, turn, round({_HARMONIC}, 9) AS token_f1 FROM x",
)
def answer_token_f1(spark, sf):
    return evaluate.token_f1(_answers(spark, sf), ["conv_id", "turn"]).withColumn("token_f1", F.round("token_f1", 9))


@query("answer_exact_match", cte(_ANSWERS) + "SELECT conv_id, turn, (array_to_string(p, ' ') = array_to_string(r, ' '))::INTEGER::DOUBLE AS exact_match FROM a")
def answer_exact_match(spark, sf):
    a = _answers(spark, sf)
    return a.select("conv_id", "turn", (T.normalized_answer(F.col("prediction")) == T.normalized_answer(F.col("reference"))).cast("double").alias("exact_match"))


@query(
    "rouge_l",
    cte(_ANSWERS,
        # one row of the length table a word of the prediction: a match extends the row before, the running maximum goes on
        "lcs AS (SELECT conv_id, turn, p, r, 0 AS i, list_transform(r, lambda w: 0) AS row FROM a UNION ALL SELECT conv_id, turn, p, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN r[k] = p[i + 1] THEN CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + 1 ELSE row[k] END))) FROM lcs WHERE i < len(p))",
        "x AS (SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN coalesce(row[len(r)], 0) / len(p) ELSE 0 END AS p, CASE WHEN len(r) > 0 THEN coalesce(row[len(r)], 0) / len(r) ELSE 0 END AS r FROM lcs WHERE i = len(p))")
    + f"SELECT conv_id, turn, round({_HARMONIC}, 9) AS rouge_l_f1 FROM x",
)
def rouge_l(spark, sf):
    return evaluate.answer_metrics(_answers(spark, sf)).select("conv_id", "turn", F.round("rouge_l_f1", 9).alias("rouge_l_f1"))


# ------------------------------------------------------------------------------------------------ hashes and names


@query(
    "grouped_split",
    "SELECT source, doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT source, doc_id, ('0x' || substr(sha1(source || ':' || (doc_id % 50)), 1, 8))::BIGINT % 100 AS b FROM documents)",
)
def grouped_split(spark, sf):
    group = F.concat("source", F.lit(":"), (F.col("doc_id") % 50).cast("string"))
    return P.table(spark, sf, "documents").select("source", "doc_id", T.grouped_split(group).alias("split"))


@query("content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


@query("safe_name", "SELECT doc_id, regexp_replace(right(text, 60), '[^A-Za-z0-9._-]+', '_', 'g') || '-' || substr(sha1(text), 1, 12) AS name FROM documents WHERE len(text) > 0")
def safe_name(spark, sf):
    return P.table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", T.safe_name(F.col("text")).alias("name"))


@query(
    "evidence_mapping_exact",
    cte(SENTENCES, f"n AS (SELECT paper_id, node_id, split_part(node_id, ':', 1)::BIGINT AS d, array_to_string({answer_words('text')}, ' ') AS t FROM sentence)",
        "f AS (SELECT paper_id, t, min_by(node_id, d * 1000000 + split_part(node_id, ':', 2)::BIGINT) AS first FROM n WHERE t <> '' GROUP BY 1, 2)")
    + "SELECT n.node_id AS evidence_id, first AS node_id, CASE WHEN n.t = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN n.t = '' THEN 'empty' ELSE 'exact' END AS method FROM n LEFT JOIN f USING (paper_id, t) WHERE d % 50 = 0",
)
def evidence_mapping_exact(spark, sf):
    """Every fiftieth document's sentences looked up among all sentences of their source; the first equal one is meant."""
    n = P.sentences(P.table(spark, sf, "documents")).withColumn("ord", F.col("doc_id") * 1000000 + F.col("ord"))
    e = n.where("doc_id % 50 = 0").select(F.col("node_id").alias("evidence_id"), "paper_id", F.col("text").alias("evidence"))
    return mapping.map_evidence(e, n)


@query(
    "evidence_jaccard",
    cte(f"t AS (SELECT item_id, list_distinct({answer_words('text')}) AS w FROM benchmark WHERE item_id % 50 = 0)", f"n AS (SELECT doc_id, list_distinct({answer_words('text')}) AS w FROM documents)")
    + "SELECT item_id AS evidence_id, doc_id AS node_id, round(len(list_intersect(t.w, n.w)) / (len(t.w) + len(n.w) - len(list_intersect(t.w, n.w))), 9) AS jaccard FROM t, n WHERE len(list_intersect(t.w, n.w)) > 0",
)
def evidence_jaccard(spark, sf):
    """Every fiftieth passage against all documents that share a word with it."""
    words = lambda df, key, name: df.select(F.col(key).alias(name), F.array_distinct(T.words_of_answer(F.col("text"))).alias("words"))
    asked = words(P.table(spark, sf, "benchmark").where("item_id % 50 = 0"), "item_id", "evidence_id")
    found = mapping.jaccard(asked, words(P.spread(P.table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "node_id"))
    return found.withColumn("jaccard", F.round("jaccard", 9))


# ------------------------------------------------------------------------------------------------ answers, hits as output


@query(
    "score_components",
    cte(VECTORS, f"two AS (SELECT query_id, node_id, score AS embedding, {_SECOND} AS graph FROM recalled)")
    + "SELECT query_id, node_id, 'embedding' AS scorer, embedding AS value FROM two UNION ALL SELECT query_id, node_id, 'graph', graph FROM two WHERE graph IS NOT NULL",
)
def score_components(spark, sf):
    """Scorers' values of every recalled vector as a map, spread again; a value from before gives way to the new one."""
    hits = _recalled(spark, sf).withColumn("embedding", F.col("score")).withColumn("graph", F.when(F.col("ord") % 3 == 0, F.lit(None)).otherwise(((F.col("ord") * 7919) % 1000).cast("double")))
    before = F.create_map(F.lit("embedding"), F.lit(-5.0))
    return reports.score_components(hits, ["embedding", "graph"], before).select("query_id", "node_id", F.explode("components").alias("scorer", "value"))


@query("hit_responses", cte(VECTORS) + "SELECT query_id, pos - 1 AS place, node_id, node_type, score FROM recalled")
def hit_responses(spark, sf):
    """Recalled vectors as JSON responses, read back."""
    nodes = P.vectors(P.table(spark, sf, "embeddings")).select("node_id", F.lit("a text").alias("text"), F.lit(None).cast("string").alias("image_path"))
    made = reports.responses(_recalled(spark, sf), nodes)
    listed = F.from_json("response", "array<struct<node_id:string,paper_id:string,node_type:string,text:string,image_path:string,score:double>>")
    return made.select("query_id", F.posexplode(listed).alias("place", "h")).select("query_id", "place", "h.node_id", "h.node_type", "h.score")


@query(
    "parsed_answers",
    "SELECT conv_id || ':' || turn || ':' || role AS query_id, coalesce(text, '') AS answer, CASE WHEN turn % 3 = 2 THEN '' ELSE conv_id || ' t' || turn END AS cited, turn % 3 <> 2 AS valid FROM conversations",
)
def parsed_answers(spark, sf):
    """Every turn as a model's output: a JSON object, one in a fence, or plain text."""
    c = P.table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    ids = F.array(F.col("conv_id").cast("string"), F.col("conv_id").cast("string"), F.concat(F.lit("t"), F.col("turn").cast("string")))
    body = F.to_json(F.struct(F.col("text").alias("answer"), ids.alias("evidence_ids")))
    output = F.when(F.col("turn") % 3 == 0, body).when(F.col("turn") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.col("text"))
    raw = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("query_id"), output.alias("output"))
    return reports.parsed_answers(raw).select("query_id", "answer", F.array_join("node_ids", " ").alias("cited"), "valid")


_PLACE = "list_filter(range(1, len(w) - len(s) + 2), lambda i: w[i] = s[1] AND w[i:i + len(s) - 1] = s)[1]"


@query(
    "locate_sentences",
    cte("d AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents)",
        "e AS (SELECT doc_id, w, 'exact' AS how, w[3:10] AS s FROM d WHERE len(w) >= 3 UNION ALL SELECT doc_id, w, 'part', w[8:16] FROM d WHERE len(w) >= 16)",
        f"p AS (SELECT doc_id, how, {_PLACE} - 1 AS a, len(s) AS n FROM e)",
        "b AS (SELECT doc_id, how, list_transform(range(a, a + n), lambda i: i % 10) AS c, a, n FROM p)")
    + "SELECT doc_id || ':' || how AS node_id, how, list_min(c) * 50.0::DOUBLE AS x0, (a // 10) * 12.0::DOUBLE AS y0, list_max(c) * 50.0::DOUBLE + 40 AS x1, ((a + n - 1) // 10) * 12.0::DOUBLE + 10 AS y1 FROM b",
)
def locate_sentences(spark, sf):
    """Eight words of each document, and twelve of which only the middle ones are on the page, found again among its laid-out words."""
    d = P.spread(P.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "").alias("w"))
    at = lambda i, per, unit: F.floor(i / per).cast("double") * unit
    boxed = F.transform("w", lambda x, i: F.struct(x.alias("word"), ((i % 10) * 50.0).alias("x0"), at(i, 10, 12.0).alias("y0"), ((i % 10) * 50.0 + 40).alias("x1"), (at(i, 10, 12.0) + 10).alias("y1")))
    pages = d.select("doc_id", F.lit(1).alias("page"), boxed.alias("words"))
    sentence = lambda how, words: d.select(F.concat(F.col("doc_id").cast("string"), F.lit(f":{how}")).alias("node_id"), "doc_id", F.lit(1).alias("page"), F.array_join(words, " ").alias("text"), F.size("w").alias("n"))
    none = F.array(*[F.lit("\u0001")] * 3)
    asked = sentence("exact", F.slice("w", 3, 8)).where("n >= 3").unionByName(sentence("part", F.concat(none, F.slice("w", 8, 9))).where("n >= 16")).drop("n")
    return reports.located(asked, pages, "doc_id").select("node_id", "how", "bbox.*")
