"""Document fingerprints: a quartile bucket digest of hashed byte triplets, and a bounded difference score (operator 9).

The digest of a text: 256 buckets count hashed triplets of the bytes in each window of five; each bucket is coded by the
quartile its count falls in (two bits), beside a checksum-free header of the text's length and the quartile ratios. A text of one to
four bytes is followed by zero bytes, so that its windows hold all of it; the empty text has no triplets.
A digest is 2 + 2 + 128 hexadecimal digits. Equal texts have equal digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, in_id_order, mix64, modest_batches, text_of

BUCKETS = 256
#: Offsets of the triplets taken in a window of five bytes: the window's last byte with two before it.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Bounds of the parts of the difference; likeness is 1 - difference / MOST, at least 0.
MOST = 400.0
LENGTH_STEP, RATIO_STEP, FAR = 12, 12, 6


def _tables() -> np.ndarray:
    """A byte's scramble for each triplet kind and each of its three places."""
    with np.errstate(over="ignore"):
        x = mix64(np.arange(1, 1 + 256 * 3 * len(TRIPLETS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x & np.uint64(0xFFFF)).astype(np.uint16).reshape(len(TRIPLETS), 3, 256)


_TABLE = _tables()


def bucket_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of the 256 buckets over all windows of one text."""
    counts = np.zeros(BUCKETS, np.int64)
    if 0 < len(raw) < 5:
        raw = np.concatenate((raw, np.zeros(4, np.uint8)))
    for a in range(0, max(len(raw) - 4, 0), 1 << 18):
        part = raw[a : a + (1 << 18) + 4]
        n = len(part) - 4
        last = part[4:]
        for k, (i, j) in enumerate(TRIPLETS):
            h = _TABLE[k, 0][last]
            h ^= _TABLE[k, 1][part[4 - i : 4 - i + n]]
            h += _TABLE[k, 2][part[4 - j : 4 - j + n]]
            h ^= h >> np.uint16(7)
            counts += np.bincount((h & np.uint16(255)), minlength=BUCKETS)
    return counts


def _length_code(n: int) -> int:
    """Lengths by factors of about 1.2, modulo 256."""
    return int(np.log(max(n, 1)) / np.log(1.2)) & 255


def digest(raw: np.ndarray) -> str:
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes[0::4] << 6) | (codes[1::4] << 4) | (codes[2::4] << 2) | codes[3::4]
    ratios = (int(q1 * 100 // q3) & 15, int(q2 * 100 // q3) & 15) if q3 else (0, 0)
    return f"{_length_code(len(raw)):02x}{ratios[0]:x}{ratios[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def _circle(a: int, b: int, size: int) -> int:
    d = abs(a - b)
    return min(d, size - d)


def difference(a: str, b: str) -> float:
    """A bounded score of how two digests differ: bucket codes, then length and quartile ratios."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    total = 0.0
    length = _circle(int(x[0]), int(y[0]), 256)
    total += length if length <= 1 else min(length * LENGTH_STEP, 8 * LENGTH_STEP)
    for shift in (4, 0):
        d = _circle(int(x[1]) >> shift & 15, int(y[1]) >> shift & 15, 16)
        total += d if d <= 1 else min((d - 1), 4)
    codes = [np.stack([(z[2:] >> s) & 3 for s in (6, 4, 2, 0)]).astype(np.int8) for z in (x, y)]
    gap = np.abs(codes[0] - codes[1])
    return total + float(np.where(gap == 3, FAR, gap).sum())


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 at a difference of MOST or more."""
    return 1.0 - min(difference(a, b), MOST) / MOST


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many, or all, of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


_PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PART_SCHEMA = f"kind int, part int, {_PAIR_SCHEMA}, text string"


def _pair(doc_id, text: str, fp: str, following: str, following_fp: str) -> tuple:
    new = edited_text(text, following)
    edited = digest(_raw(new)) if new != text else fp
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, edited, likeness(fp, edited), likeness(fp, following_fp))


def _partition(batches):
    """Pairs of neighbours within one sorted partition; its first and last document go on as kinds 1 and 2."""
    from pyspark import TaskContext

    part, held, names = TaskContext.get().partitionId(), None, [x.split(" ")[0] for x in _PART_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def end(kind, doc):
        return (kind, part, doc[0], None, None, doc[2], None, None, None, doc[1])

    for b in batches:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            doc = (doc_id, text, digest(_raw(text)))
            rows.append((0, part, *_pair(*held, doc[1], doc[2]), None) if held else end(1, doc))
            held = doc
        if rows:
            yield batch(rows)
    if held:
        yield batch([end(2, held)])


def _seams(batches):
    for b in batches:
        rows = [_pair(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_fingerprint"]) for r in b.to_pylist()]
        names = [x.split(" ")[0] for x in _PAIR_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored), with the digests of its text and its edited text.

    Order is ascending doc_id (null first; cast to long: a value that is none is an error), equal doc_ids by text. A null text is empty.
    Repeated rows are documents each, and each other's next. A single document is its own next. Very long texts are digested a
    quarter of a million bytes at a time. A table without rows gives none. Documents are dealt by ranges of doc_id and sorted; neighbours meet within a partition, and the two end documents of
    each partition (two rows a partition, no more) are paired across partitions.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    modest_batches(spark)
    scratch = Scratch(spark, "digest")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    made = scratch.write(in_id_order(base).mapInArrow(_partition, _PART_SCHEMA))
    inner = made.where("kind = 0").select(*[x.split(" ")[0] for x in _PAIR_SCHEMA.split(", ")])
    ends = made.where("kind > 0")
    around = Window.orderBy("part")
    firsts = ends.where("kind = 1").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    order = firsts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(around), F.first("part").over(around.rowsBetween(Window.unboundedPreceding, 0))))
    lasts = ends.where("kind = 2").select("part", "doc_id", "text", "fingerprint")
    seams = lasts.join(order, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return inner.unionByName(seams.mapInArrow(_seams, _PAIR_SCHEMA))


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
