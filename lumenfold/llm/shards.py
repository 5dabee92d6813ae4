"""Sharding by a permutation-filled lookup table (operator 3).

Every shard prefers the table's slots in an order of its own (an offset and a step from hashes of its name; the size is
prime, so the order visits all). Shards take turns claiming their next free slot until the table is full. A key's hash names
a slot, and the broadcast table (SLOTS rows, whatever the data) gives its shard in constant time. Shards hold equal numbers of
slots within one, and few keys move when a shard comes or goes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "little")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards, slots: int = SLOTS) -> list[int]:
    """The index into shards of each slot's owner."""
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or not _is_prime(slots):
        raise ValueError("shards must be distinct, at least one and at most the slots, whose number must be prime")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, filled = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            filled += 1
            if filled == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots))


def placed(docs: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs' rows as `doc` (a struct of all columns, whatever their names) with slot and shard.

    Rows of equal key go to one shard; a null key counts as the empty string. Tables without rows give none.
    """
    names = list(shards)
    table = pa.table({"table_slot": pa.array(range(slots), pa.int64()), "shard": pa.array([names[i] for i in lookup_table(names, slots)])})
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), slot_of(docs[key], slots).alias("slot"))
    # bounded: the table has `slots` rows
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(table)), F.col("slot") == F.col("table_slot")).select("doc", "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards=SHARDS, files: int = 1) -> None:
    """docs as Parquet below path, a folder a shard (column `shard`) with `files` files; a shard's rows are salted over them."""
    n = len(list(shards))
    rows = placed(docs, key, shards).withColumn("__salt", F.pmod(F.xxhash64("doc"), F.lit(files)))
    rows.repartition(n * files, "shard", "__salt").select("doc.*", "shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return placed(docs).select("doc.doc_id", "slot", "shard")
