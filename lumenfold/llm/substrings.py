"""Substring dedup: windows of words that repeat anywhere are found level by level and removed (operator 6).

Lengths double up to the window: 9, 18, 35 words for a window of 35. A repeated window's shorter windows repeat too, so
only positions whose windows repeat at one length are extended to twice that length. At the shortest length a window is
stood for by the least-hashed short window within it (equal windows choose the same one), which thins the first and
widest exchange about fourteenfold without losing a repeat.

Exchange: each block of texts deals its hashes into buckets as packed arrays. A hash that a block itself holds twice is
settled there and sent once, so a passage shared by a third of all documents costs one entry a block. Lower levels only
propose, by 64 bits; what is removed rests on 128 bits of two independent families at the full length: of 10^13 windows
a pair is expected to agree by chance in one run of 10^12.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, mix64, modest_batches, shuffle_width, text_buffers, text_of, window_hashes, word_hashes, word_spans

WINDOW = 35
#: Halving stops at this many words or fewer.
SHORTEST = 12
BLOCK_BYTES = 4 << 20
_CHUNK = "bucket int, hash binary, more binary, flag binary, rows binary, pos binary"
_GAPS = re.compile(rb"[\x20\x09-\x0D]+")


def levels(window: int) -> list[int]:
    """Ascending lengths; each is at most twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def blocks(batch, limit: int = BLOCK_BYTES):
    """Row ranges of a batch with about `limit` bytes of text each, at least one row."""
    _, offsets = text_buffers(batch.column("text"))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class _Words:
    """Word hashes of a block, with each position's document and its last valid start for a window length."""

    def __init__(self, col):
        self.raw, self.offsets = text_buffers(col)
        self.starts, self.ends, self.first = word_spans(self.raw, self.offsets)
        self.hashes = word_hashes(self.raw, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, length: int, family: int) -> np.ndarray:
        return window_hashes(self.hashes if not family else word_hashes(self.raw, self.starts, self.ends, family), length)

    def valid(self, length: int) -> np.ndarray:
        """Positions where a window of `length` words lies within one document."""
        n = max(len(self.hashes) - length + 1, 0)
        return np.arange(n) + length <= self.first[self.doc[:n] + 1]

    def anchors(self, base: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the base windows, and for each window start the leftmost least one within the window."""
        h = window_hashes(self.hashes, base)
        width, n = window - base + 1, len(self.hashes) - window + 1
        if n <= 0:
            return h, np.zeros(0, np.int64)
        at, low, size, done = np.arange(len(h)), h, 1, 1
        while done < width:  # least of `done` windows from each place on
            step = min(size, width - done)
            a, b = low[: len(low) - step], low[step:]
            right = b < a
            low = np.where(right, b, a)
            at = np.where(right, at[step:], at[: len(at) - step])
            done += step
            size = done
        return h, at[:n]


def _deal(words: _Words, rows: np.ndarray, at: np.ndarray, hashes: np.ndarray, buckets: int, more: np.ndarray | None = None):
    """A record batch: a packed row for each bucket, and what repeats within the block already, passed through. more: the second family's hashes."""
    more = np.zeros(0, np.uint64) if more is None else more
    order = np.argsort(hashes, kind="stable") if not len(more) else np.lexsort((more, hashes))
    h, at, m = hashes[order], at[order], more[order] if len(more) else more
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    if len(m):
        same[1:-1] &= m[1:] == m[:-1]
    twice = same[1:] | same[:-1]
    lead = ~same[:-1]
    known_at = at[twice]
    h, at, flag, m = h[lead], at[lead], twice[lead], m[lead] if len(m) else m
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    h, at, flag, bucket, m = h[by], at[by], flag[by], bucket[by], m[by] if len(m) else m
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    doc = words.doc[at]
    row, pos = rows[doc], (at - words.first[doc]).astype(np.int32)
    out = [(b, h[i:j].tobytes(), m[i:j].tobytes(), flag[i:j].tobytes(), row[i:j].tobytes(), pos[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
    if len(known_at):
        doc = words.doc[known_at]
        out.append((int(rows[0]) % buckets, b"", b"", b"", rows[doc].tobytes(), (known_at - words.first[doc]).astype(np.int32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], ["bucket", "hash", "more", "flag", "rows", "pos"])


def _listed(col) -> tuple[np.ndarray, np.ndarray]:
    """(row index, value) pairs of a column of int lists; null is an empty list."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.diff(col.offsets.to_numpy()) if not col.null_count else np.array([0 if x is None else len(x) for x in col.to_pylist()])
    return np.repeat(np.arange(len(lens)), lens), col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _first_level(lengths: list[int], buckets: int):
    base, window = lengths[0], lengths[-1]

    def run(batches):
        for whole in batches:
            for b in blocks(whole) if whole.num_rows else ():
                w = _Words(b.column("text"))
                h, anchor = w.anchors(base, window)
                chosen = np.unique(anchor[w.valid(window)])
                if len(chosen):
                    yield _deal(w, b.column("__row").to_numpy(), chosen, h[chosen], buckets, w.windows(base, 1)[chosen] if base == window else None)

    return run


def _next_level(lengths: list[int], k: int, buckets: int):
    """From what repeats at level k - 1 to the hashes at level k."""
    base, window, shorter, length = lengths[0], lengths[-1], lengths[k - 1], lengths[k]

    def run(batches):
        for whole in batches:
            for b in blocks(whole) if whole.num_rows else ():
                w = _Words(b.column("text"))
                doc, pos = _listed(b.column("found"))
                found = np.zeros(len(w.hashes) + 1, bool)
                found[w.first[doc] + pos] = True
                if k == 1:
                    _, anchor = w.anchors(base, window)
                    starts = np.flatnonzero(w.valid(window) & found[anchor])
                    wanted = starts if length == window else np.unique(np.concatenate([starts + o for o in _offsets(lengths, k)]))
                else:
                    ok = w.valid(length)
                    wanted = np.flatnonzero(ok & found[: len(ok)] & found[length - shorter : length - shorter + len(ok)])
                if len(wanted):
                    sure = w.windows(length, 1)[wanted] if length == window else None
                    yield _deal(w, b.column("__row").to_numpy(), wanted, w.windows(length, 0)[wanted], buckets, sure)

    return run


def _offsets(lengths: list[int], k: int) -> list[int]:
    """Where windows of level k start within a full window, halving from the top."""
    at = {0}
    for up in range(len(lengths) - 1, k, -1):
        at |= {a + lengths[up] - lengths[up - 1] for a in at}
    return sorted(at)


def _meet(parts: int):
    """Of the packed rows of this partition, the positions whose hash is there twice or known to repeat, packed by where their documents' lists are gathered."""

    def run(batches):
        kept, through = {"hash": [], "more": [], "flag": [], "rows": [], "pos": []}, {"rows": [], "pos": []}
        for b in batches:
            for r in b.to_pylist():
                into = kept if r["hash"] else through
                for name, values in into.items():
                    values.append(r[name])
        h, more, flag = (np.frombuffer(b"".join(kept[k]), t) for k, t in (("hash", np.uint64), ("more", np.uint64), ("flag", bool)))
        order = np.argsort(h) if not len(more) else np.lexsort((more, h))
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order][1:] == h[order][:-1]
        if len(more):
            same[1:-1] &= more[order][1:] == more[order][:-1]
        mask = np.empty(len(h), bool)
        mask[order] = same[1:] | same[:-1]
        mask &= ~flag  # what a block knows to repeat was passed through there
        rows = np.concatenate((np.frombuffer(b"".join(through["rows"]), np.int64), np.frombuffer(b"".join(kept["rows"]), np.int64)[mask]))
        pos = np.concatenate((np.frombuffer(b"".join(through["pos"]), np.int32), np.frombuffer(b"".join(kept["pos"]), np.int32)[mask]))
        to = (mix64(rows.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        rows, pos, to = rows[order], pos[order], to[order]
        cut = np.searchsorted(to, np.arange(parts + 1))
        out = [(k, rows[i:j].tobytes(), pos[i:j].tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "rows", "pos"])

    return run


def _gather(batches):
    """One row for each document that has positions, with their list."""
    rows, pos = [], []
    for b in batches:
        for r in b.to_pylist():
            rows.append(np.frombuffer(r["rows"], np.int64))
            pos.append(np.frombuffer(r["pos"], np.int32))
    if not rows:
        return
    rows, pos = np.concatenate(rows), np.concatenate(pos)
    order = np.lexsort((pos, rows))
    rows, pos = rows[order], pos[order]
    lead = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    for a in range(0, len(lead), 5000):
        part = lead[a : a + 5000]
        end = lead[a + 5000] if a + 5000 < len(lead) else len(rows)
        offsets = np.append(part, end)
        yield pa.RecordBatch.from_arrays([pa.array(rows[part]), pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(pos[offsets[0] : end]))], ["__row", "found"])


def _kept_of(window: int, texts: bool):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(text: pa.Array, found: pa.Array) -> pa.Array:
        raw, offsets = text_buffers(text)
        starts, ends, first = word_spans(raw, offsets)
        doc, pos = _listed(found)
        edge = np.zeros(len(starts) + 1, np.int32)
        if len(pos):
            np.add.at(edge, first[doc] + pos, 1)
            np.add.at(edge, first[doc] + pos + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.concatenate((np.zeros(1, np.int64), np.cumsum(gone)))
        data, out = raw.tobytes(), []
        n_words, n_removed = np.diff(first), removed[first[1:]] - removed[first[:-1]]
        for d in range(len(first) - 1):
            a, b = int(first[d]), int(first[d + 1])
            if n_removed[d]:
                stay = np.flatnonzero(np.diff(np.concatenate(([True], gone[a:b], [True])).astype(np.int8)))
                spans = [(int(starts[a + i]), int(ends[a + j - 1])) for i, j in zip(stay[0::2], stay[1::2], strict=True)]
            else:
                spans = [(int(starts[a]), int(ends[b - 1]))] if b > a else []
            if texts:
                out.append(b"\n".join(data[i:j] for i, j in spans).decode("utf-8") if n_removed[d] else data[offsets[d] : offsets[d + 1]].decode("utf-8"))
            else:
                out.append(hashlib.sha256(b" ".join(_GAPS.sub(b" ", data[i:j]) for i, j in spans)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_removed), pa.array(out, pa.string())], fields=list(kind))

    run.__annotations__ = {"text": pa.Array, "found": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "n_words long, n_removed long, kept string")


def _drop_at_exit(spark, name: str) -> None:
    """The bucketed table's name goes with the application, as its files do."""

    def drop():
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """docs' rows as `doc` (a struct of all their columns but text, whatever their names) with n_words, n_removed and kept.

    kept is the sha256 of the kept words joined by one space or, with texts, the text without the removed words (what is
    left of a changed text between two removals stays as it was; pieces are joined by a newline). Each word in a window of
    `window` words that also starts anywhere else, in the same document or another, is removed. A null or empty text has no
    words. Rows are told apart by place, not by doc_id: repeated rows are copies of each other and lose their windows. A very long text is a
    block of its own.
    Tables without rows give none. The texts are written once, bucketed by row number, so that later levels join without
    moving them again.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    scratch, n = Scratch(spark, "substrings"), max(shuffle_width(spark), 2)
    lengths = levels(window)
    name = f"lumenfold_{uuid.uuid4().hex}"
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("doc"), text_of(docs).alias("text"))
    numbered = base.withColumn("__row", F.monotonically_increasing_id())
    numbered.repartition(n, "__row").write.option("compression", "zstd").option("path", f"{scratch.base}/texts").bucketBy(n, "__row").saveAsTable(name)
    _drop_at_exit(spark, name)
    table = spark.table(name)
    found = None
    for k in range(len(lengths)):
        if found is None:
            dealt = table.select("__row", "text").mapInArrow(_first_level(lengths, n), _CHUNK)
        else:
            dealt = table.select("__row", "text").join(found.hint("shuffle_hash"), "__row").mapInArrow(_next_level(lengths, k, n), _CHUNK)
        met = dealt.repartitionById(n, F.col("bucket")).mapInArrow(_meet(n), "part int, rows binary, pos binary")
        found = scratch.write(met.repartitionById(n, F.col("part")).mapInArrow(_gather, "__row long, found array<int>"))
    out = table.join(found.hint("shuffle_hash"), "__row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<int>")))
    return out.withColumn("made", _kept_of(window, texts)("text", "found")).select("doc", "made.n_words", "made.n_removed", "made.kept")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, same rows and columns, with the repeated windows' words taken out of text, and n_chars (if there) its length."""
    made = remove_repeats(docs, window, texts=True)
    out = []
    for f in docs.schema:
        if f.name == "text":
            out.append(F.col("kept").alias("text"))
        elif f.name == "n_chars":
            out.append(F.length("kept").cast(f.dataType).alias("n_chars"))
        else:
            out.append(F.col("doc").getField(f.name).alias(f.name))
    return made.select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
