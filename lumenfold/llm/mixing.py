"""Mixing sources to target weights by Pfair scheduling (operator 2).

Each source's documents form blocks. Block k (from 1) of a source of weight w (weights add up to one) is released at slot
floor((k-1)/w) and due by slot ceil(k/w); in every slot the released block of earliest deadline goes, so a source never
deviates from its share by a block or more. Weights are whole numbers over their sum, however uneven, so releases and deadlines are exact.
When a source runs out, a new phase begins: the rest go on with their weights brought to one.

The schedule is made on the driver, slot by slot: at most MOST_BLOCKS slots, and one more a source, whatever the table's size, for
blocks grow with it.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import isqrt, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width

#: Rows of a block at least, and blocks at most (besides each source's last): the plan that is broadcast has four bytes a block.
BLOCK_ROWS, MOST_BLOCKS = 16, 1 << 20
#: Sources at most: their names and counts are on the driver, and weights are given by name.
MOST_SOURCES = 1 << 20


def whole_weights(weights: dict) -> dict:
    """Weights (numbers or decimal strings) as whole numbers in the same proportions."""
    exact = {k: w if isinstance(w, Fraction) else Fraction(str(w)) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("target weights must be positive")
    common = lcm(*(w.denominator for w in exact.values())) if exact else 1
    return {k: int(w * common) for k, w in exact.items()}


def schedule(blocks: dict, weights: dict) -> tuple[dict, list[int]]:
    """(slots of each source's blocks, first slots of the phases) for whole-number weights.

    Ties of deadlines go to the greater weight, then to the lesser name (no name first). At a phase's start all first
    blocks are released and their deadlines are in the order of weights, so that sources not served yet wait in a chain, not in a heap.
    """
    order = sorted((k for k in blocks if blocks[k] > 0), key=lambda k: (-weights[k], k is not None, k or ""))
    n, given, size = [weights[k] for k in order], [[] for _ in order], [blocks[k] for k in order]
    left = list(range(len(order)))  # sources with blocks left, in order
    slot, starts, total = 0, [], sum(n)
    while left:
        begun, at, ended = slot, 0, None
        starts.append(begun)
        served: dict[int, int] = {}
        ready: list[tuple[int, int]] = []
        waiting: list[tuple[int, int]] = []
        while ended is None:
            while waiting and waiting[0][0] <= slot - begun:
                i = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(served[i] + 1) * total // n[i]), i))
            first = (-(-total // n[left[at]]), left[at]) if at < len(left) else None
            if first is not None and (not ready or first < ready[0]):
                i, at = left[at], at + 1
            else:
                i = heapq.heappop(ready)[1]
            given[i].append(slot)
            served[i] = served.get(i, 0) + 1
            slot += 1
            if len(given[i]) == size[i]:
                ended = i
            else:
                heapq.heappush(waiting, (served[i] * total // n[i], i))
        left.remove(ended)
        total -= n[ended]
    return dict(zip(order, given, strict=True)), starts


def tempered(counts: dict, temper: float = 0.5) -> dict:
    """Counts to the power `temper` in millionths, at least one: exact square roots, rounded down, for a half."""
    return {k: max(1, isqrt(c * 10**12) if temper == 0.5 else round(c**temper * 10**6)) for k, c in counts.items()}


def _digest(docs: DataFrame, by) -> Column:
    """Orders a source's rows as by chance, yet the same in every run: rows alike in all of `by` are interchangeable."""
    return F.md5(F.concat_ws("|", *[docs[f"`{c}`"].cast("string") for c in by]).cast("binary"))


def mixed(docs: DataFrame, weights: dict | None = None, temper: float = 0.5, block_rows: int = BLOCK_ROWS, by: list[str] | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """docs' rows as `doc` (a struct of all columns, whatever their names) with block, slot and place.

    place orders the mix; slot is the block's, block its number within the source. Target weights are given by source name or, by default,
    the sources' row counts to the power `temper`; a source without a given weight gets the least given one. All rows
    stay. A null source is a source of its own. Documents of a source are ordered by a digest of the columns `by` (all columns, by
    default; other nulls count as nothing), then by a hash of the whole row, so that rows of equal doc_id that differ have a settled order and only
    identical rows are interchangeable. Blocks have block_rows rows, more where that gives over most_blocks blocks. Very long texts only
    weigh in the exchange. Tables without rows give none. Ranks are counted within (source, range of digests), so a source that holds a
    third of the rows, or an id that many rows share, is spread over all ranges; identical rows share one.
    """
    return _mixed(docs, weights, temper, block_rows, by, most_blocks)[0]


def _mixed(docs: DataFrame, weights=None, temper=0.5, block_rows=BLOCK_ROWS, by=None, most_blocks=MOST_BLOCKS) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    ranges = min(4 * max(shuffle_width(spark), 2), 1 << 20)
    named = docs["source"].cast("string")
    keyed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        F.concat(F.when(named.isNull(), "").otherwise("="), F.coalesce(named, F.lit(""))).alias("s"),
        _digest(docs, by or docs.columns).alias("h"),
        F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns]).alias("x"),
    ).withColumn("b", F.floor(F.conv(F.substring("h", 1, 5), 16, 10).cast("long") * ranges / (1 << 20)))
    cells = keyed.groupBy("s", "b").count()
    counts = {r["s"][1:] if r["s"] else None: r["n"] for r in cells.groupBy("s").agg(F.sum("count").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = max(block_rows, -(-sum(counts.values()) // most_blocks))
    weights = tempered(counts, temper) if weights is None else whole_weights({k: weights.get(k, min(weights.values(), key=lambda w: Fraction(str(w)))) for k in counts})
    slots, _ = schedule({k: -(-n // rows) for k, n in counts.items()}, weights)
    kinds = pa.schema([("p_source", pa.string()), ("slots", pa.list_(pa.int32()))])
    plan = spark.createDataFrame(pa.Table.from_pydict({"p_source": ["" if k is None else f"={k}" for k in slots], "slots": list(slots.values())}, kinds))
    before = cells.select(F.col("s").alias("c_s"), F.col("b").alias("c_b"), (F.sum("count").over(Window.partitionBy("s").orderBy("b")) - F.col("count")).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "x")))
    ranked = ranked.join(before, (F.col("s") == F.col("c_s")) & (F.col("b") == F.col("c_b"))).withColumn("r", F.col("before") + F.col("r") - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("r") / rows))
    # bounded: a row a source, four bytes a block
    out = ranked.join(F.broadcast(plan), F.col("s") == F.col("p_source")).withColumn("slot", F.get("slots", F.col("block").cast("int")).cast("long"))
    return out.select("doc", "block", "slot", (F.col("slot") * rows + F.col("r") % rows).alias("place")), sum(map(len, slots.values())) * rows


def in_mixed_order(docs: DataFrame, **how) -> DataFrame:
    """docs with its columns, dealt into partitions by place and sorted: every stretch of the output holds the target mix."""
    n = max(shuffle_width(docs.sparkSession), 2)
    out, places = _mixed(docs, **how)
    part = F.least(F.lit(n - 1), F.floor(F.col("place") * n / F.lit(max(places, 1)))).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("place").select("doc.*")


#: The query in DuckDB SQL: the schedule slot by slot, with all sources' states in every step.
SQL = f"""
WITH RECURSIVE ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', doc_id::VARCHAR, source))) - 1 AS r FROM documents),
size AS (SELECT greatest({BLOCK_ROWS}, ceil(count(*) / {MOST_BLOCKS}))::BIGINT AS z FROM documents),
counted AS (SELECT source, count(*)::HUGEINT AS c, floor(sqrt(count(*)) * 1e6)::HUGEINT AS q FROM documents GROUP BY 1),
weighed AS (SELECT source, ceil(c / z)::BIGINT AS blocks, greatest(1, CASE WHEN (q + 1) * (q + 1) <= c * 1000000000000 THEN q + 1 WHEN q * q > c * 1000000000000 THEN q - 1 ELSE q END)::BIGINT AS n FROM counted, size),
named AS (SELECT *, row_number() OVER (ORDER BY n DESC, source NULLS FIRST) AS i FROM weighed),
run AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS begun, source, i, n, blocks, 0::BIGINT AS done, 0::BIGINT AS before, false AS goes FROM named
  UNION ALL
  SELECT slot + 1, CASE WHEN over THEN slot + 2 ELSE begun END, source, i, n, blocks, done + mine::INTEGER, CASE WHEN over THEN done + mine::INTEGER ELSE before END, mine
  FROM (SELECT *, bool_or(mine AND done + 1 = blocks) OVER () AS over
        FROM (SELECT *, live AND released AND row_number() OVER (ORDER BY NOT (live AND released), due, i) = 1 AS mine
              FROM (SELECT *, done < blocks AS live, ((done - before) * total) // n <= slot + 1 - begun AS released, ((done - before + 1) * total + n - 1) // n AS due
                    FROM (SELECT *, sum(CASE WHEN done < blocks THEN n ELSE 0 END) OVER () AS total FROM run)) WHERE live)))
SELECT doc_id, ranked.source, done - 1 AS block, slot, slot * z + r % z AS place
FROM run JOIN ranked ON run.source IS NOT DISTINCT FROM ranked.source AND r // (SELECT z FROM size) = done - 1, size WHERE goes
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixed(docs).select("doc.doc_id", "doc.source", "block", "slot", "place")
