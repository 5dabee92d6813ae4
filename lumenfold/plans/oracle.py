"""DuckDB SQL for the registered queries: shared parts as common table expressions."""

from __future__ import annotations

import re


def cte(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


#: Tokens, with the case folding of functions.text.
def tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[A-Za-z0-9_]+|[\\p{{L}}\\p{{N}}_]'), lambda x: replace(lower(x), 'ß', 'ss'))"


def answer_words(c: str) -> str:
    return f"regexp_extract_all(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"


def token_cost(c: str) -> str:
    return f"greatest(1, len(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9_]+|[^\\x00-\\x7F]')))::BIGINT"


SENTENCES = r"""
held AS (SELECT doc_id, source, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(Figs?|Eqs?|Refs?|et al|i\.e|e\.g)\.', '\1' || chr(1), 'g') AS t FROM documents),
cut AS (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？])\s+([A-Z0-9一-鿿])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda p: trim(replace(p, chr(1), '.'))), lambda p: p <> '') AS parts FROM held),
piece AS (SELECT doc_id, source, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut),
grouped AS (SELECT doc_id, source, p, i, sum(CASE WHEN i = 1 OR len(p) >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM piece),
sentence AS (SELECT doc_id, source AS paper_id, (g - 1)::INTEGER AS ord, doc_id || ':' || (g - 1) AS node_id, string_agg(p, ' ' ORDER BY i) AS text FROM grouped GROUP BY doc_id, source, g)
"""

VECTORS = """
vec AS (SELECT vec_id::VARCHAR AS node_id, (vec_id % 20)::VARCHAR AS paper_id, ['Sentence', 'Figure', 'Table', 'Caption', 'ChartData'][label % 5 + 1] AS node_type, vec_id AS ord, label,
        list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS unit FROM embeddings),
sim AS (SELECT q.ord AS query_id, v.node_id, v.paper_id, v.node_type, v.ord, v.label, q.label AS asked, round(list_inner_product(q.unit, v.unit), 9) AS score FROM vec q JOIN vec v ON q.ord % 50 = 0),
typed AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_type ORDER BY score DESC, ord) AS tr FROM sim),
recalled AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_position(['Sentence', 'Figure', 'Table', 'Caption', 'ChartData'], node_type), tr))::INTEGER AS pos FROM typed WHERE tr <= 25)
"""

GRAPH = """
line AS (SELECT l_orderkey AS ok, l_linenumber AS ln, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, sum(l_quantity)::BIGINT AS qty, min(l_discount) AS disc FROM lineitem GROUP BY 1, 2),
nodes AS (
  SELECT 'l' || ok || ':' || ln AS node_id, 'c' || o_custkey AS paper_id, 'Sentence' AS node_type, 'Line ' || ln || ' of order ' || ok || ' ships ' || qty || ' units.' AS text, NULL::VARCHAR AS image_path FROM line JOIN orders ON ok = o_orderkey
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'Figure', NULL, 'figures/' || o_orderkey || '.png' FROM orders
  UNION ALL SELECT 'k' || o_orderkey, 'c' || o_custkey, 'Caption', 'Figure ' || o_orderkey || '. Priority ' || o_orderpriority, NULL FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT 'd' || o_orderkey, 'c' || o_custkey, 'ChartData', 'Total ' || round(o_totalprice * 100)::BIGINT, NULL FROM orders WHERE o_orderkey % 4 = 0),
edges AS (
  SELECT 'l' || ok || ':' || ln AS src, 'o' || ok AS dst, 'refers_to' AS relation, 1.0::DOUBLE AS confidence FROM line WHERE ln % 2 = 1
  UNION ALL SELECT 'k' || o_orderkey, 'o' || o_orderkey, 'caption_of', 1.0 FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT 'd' || o_orderkey, 'o' || o_orderkey, 'derived_from', 1.0 FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'l' || ok || ':' || ln, 'l' || ok || ':' || nxt, 'next_sentence', round(1 - 3 * disc, 6) FROM (SELECT ok, ln, disc, lead(ln) OVER (PARTITION BY ok ORDER BY ln) AS nxt FROM line) WHERE nxt IS NOT NULL),
sym AS (SELECT src AS a, dst AS b, confidence FROM edges UNION ALL SELECT dst, src, confidence FROM edges),
hits AS (SELECT * FROM (SELECT n_regionkey AS query_id, 'l' || ok || ':' || ln AS node_id, 'c' || o_custkey AS paper_id, cents / 1e7 AS score,
           (row_number() OVER (PARTITION BY n_regionkey ORDER BY cents / 1e7 DESC, 'l' || ok || ':' || ln))::INTEGER AS pos
         FROM line JOIN orders ON ok = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE pos <= 50),
need AS (
  SELECT e.dst AS node_id, e.src AS needed FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE relation = 'caption_of' AND node_type IN ('Figure', 'Table')
  UNION SELECT e.src, e.dst FROM edges e JOIN nodes n ON n.node_id = e.src WHERE relation = 'derived_from' AND node_type = 'ChartData'
  UNION SELECT e.src, e.dst FROM edges e JOIN nodes n ON n.node_id = e.src WHERE relation = 'refers_to' AND node_type = 'Sentence'),
cost AS (SELECT node_id, paper_id, node_type, text, CASE WHEN node_type = 'Figure' THEN 512::BIGINT WHEN node_type = 'Table' THEN @COST@ + CASE WHEN image_path <> '' THEN 512 ELSE 0 END ELSE @COST@ END AS cost FROM nodes)
""".replace("@COST@", token_cost("text"))

#: The region's first ten hits and their one-hop neighbourhood.
SELECTED = """
seed AS (SELECT query_id, node_id FROM hits WHERE pos <= 10),
hop AS (SELECT query_id, node_id FROM seed UNION SELECT s.query_id, b FROM seed s JOIN sym ON a = s.node_id AND confidence >= 0.8),
closed AS (SELECT query_id, node_id FROM seed UNION SELECT c.query_id, needed FROM closed c JOIN need USING (node_id))
"""


def literal(rows: list[tuple], names: str) -> str:
    """A VALUES list as a derived table."""
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


def squeeze(sql: str) -> str:
    return re.sub(r"\n\s*\n", "\n", sql).strip()
