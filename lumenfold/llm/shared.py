"""What several operators use: written tables in the shared folder, word boundaries, column hygiene."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import range_place
from ..sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]

#: Words are runs of anything but these bytes (space, and tab to carriage return).
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

#: Rows in an Arrow batch, unless the session has another than the default: whole texts are long rows.
BATCH_ROWS = "2500"


def modest_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its executor hold of whole texts at a time; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(docs: DataFrame) -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def ascii_lower(c):
    """Lower-cases A to Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_id_order(base: DataFrame, n: int | None = None) -> DataFrame:
    """base (doc_id long, text string) dealt into about n ranges and sorted: ascending doc_id (null first), equal ids by length and hash of the text.

    Ranges are cut by the ids alone, so that texts are read once. An id (or null) that fills ranges by itself is cut again, by its
    texts; identical rows share a range.
    """
    n = n or max(shuffle_width(base.sparkSession), 2)
    steps, near = [i / n for i in range(1, n)], 100 * n
    by_text = F.shiftleft(F.length("text").cast("long"), 32) + F.shiftrightunsigned(F.xxhash64("text"), 32)
    got = base.agg(F.percentile_approx("doc_id", steps, near).alias("cuts"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    cuts = sorted(got["cuts"] or [])
    wide = {v: cuts.count(v) for v in set(cuts) if cuts.count(v) > 1}
    if got["rows"] and got["none"] * n // got["rows"] > 1:
        wide[None] = got["none"] * n // got["rows"]
    part, parts = range_place(F.col("doc_id"), sorted(set(cuts))), len(set(cuts)) + 1
    if wide:
        within = base.where(F.col("doc_id").isin([v for v in wide if v is not None]) | F.col("doc_id").isNull())
        for r in within.groupBy("doc_id").agg(F.percentile_approx(by_text, steps, near).alias("cuts")).where(F.size("cuts") > 0).collect():
            if (m := wide.get(r["doc_id"], 0)) < 2:
                continue
            inner = sorted({r["cuts"][j * n // m - 1] for j in range(1, m)})
            here, later = (F.col("doc_id").isNull(), F.col("doc_id").isNotNull()) if r["doc_id"] is None else (F.col("doc_id") == r["doc_id"], F.coalesce(F.col("doc_id") > r["doc_id"], F.lit(False)))
            part = part + F.when(here, range_place(by_text, inner)).when(later, len(inner)).otherwise(0)
            parts += len(inner)
    return base.repartitionById(max(parts, n), part.cast("int")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), by_text, F.xxhash64("text"))


# ---------------------------------------------------------------- bytes and words of Arrow text columns

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(family: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * family)) * _ODD)


_BYTE = [_byte_values(k) for k in range(2)]


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of every word, and the index of each text's first word (one more entry than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_GAP[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: sum of scrambled byte and place values, scrambled again. There are two families."""
    with np.errstate(over="ignore"):
        if not len(starts):
            return np.zeros(0, np.uint64)
        out = np.empty(len(starts), np.uint64)
        step = 1 << 16  # words at a time, so that temporaries stay in cache-sized memory
        for a in range(0, len(starts), step):
            s, e = starts[a : a + step], ends[a : a + step]
            lo, hi = int(s[0]), int(e[-1])
            place = np.arange(hi - lo, dtype=np.int64) - np.repeat(np.append(s, hi)[:-1] - lo, np.diff(np.append(s, hi)))
            part = _BYTE[family][raw[lo:hi]] * (place.astype(np.uint64) * np.uint64(2) * _ODD + np.uint64(0xD6E8FEB86659FD93))
            part ^= part >> np.uint64(29)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
            out[a : a + step] = mix64(sums[e - lo] - sums[s - lo] + (e - s).astype(np.uint64) * _ODD)
        return out


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` words, by doubling: a run is the pair of its two halves (of powers of two)."""
    with np.errstate(over="ignore"):
        n = len(words) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        have, size, acc, done = words, 1, None, 0
        while True:
            if length & size:
                acc = have[done : done + n].copy() if acc is None else mix64(acc * np.uint64(0xC2B2AE3D27D4EB4F) + have[done : done + n])
                done += size
            if size * 2 > length:
                return mix64(acc + np.uint64(length))
            have = mix64(have[:-size] * np.uint64(0x9FB21C651E98DF25) + have[size:])
            size *= 2
