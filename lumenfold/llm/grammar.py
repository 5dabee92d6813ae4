"""Token-ID output compressed by a Re-Pair grammar, shard by shard (operator 7).

A shard's ids are coded densely; rounds replace the most frequent pairs of neighbouring symbols by new nonterminals, until no
pair is frequent. The shard stores its rules, the expansion length of every rule, the place of every MARK-th sequence entry and its
documents' bounds, so any range of ids is decoded without decoding what stands before it.

Layout of a shard, little-endian: magic, then seven counts as uint64 (documents, ids, base symbols, rules, sequence
length, bytes of a sequence entry, first id's place within the partition); base symbols (uint32), rules (two uint32
each), expansion lengths of the rules (uint32), document ids (int64), documents' null flags (uint8), their first places (uint64),
first places of every MARK-th sequence entry (uint64), sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import ended
from .shared import Scratch, in_id_order, modest_batches, text_of
from .tokens import encoder, gathered, text_slices

MAGIC = b"LFRP0002"
END = 2
SHARD_IDS = 1 << 20
#: A pair is replaced while it occurs this often: a rule takes twelve bytes and saves two an occurrence, four where symbols pass 65,536.
LEAST = 8
#: A round replaces all pairs that are at least 1 / NEAR_MOST as frequent as the most frequent one.
NEAR_MOST = 8
#: Sequence entries between two that have their expansion's place stored.
MARK = 4096


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    if key.dtype == np.uint32:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules, sequence): symbols below len(base) stand for base ids, the others for a rule's pair.

    Rounds go on until no pair of neighbouring symbols occurs `least` times. A round looks its pairs up in a table by hash;
    of two pairs in one slot the more frequent is replaced, the other waits for a further round. Occurrences overlap only in runs, of which
    every second from the left is replaced.
    """
    place = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
    place[ids] = 1
    base = np.flatnonzero(place)
    place[base] = np.arange(len(base), dtype=np.uint32)
    seq, rules, symbols = place[ids], [], len(base)
    while len(seq) > 1:
        half, kind = (16, np.uint32) if symbols <= 1 << 16 else (32, np.uint64)  # the narrower keys sort faster
        key = seq[:-1].astype(kind) << kind(half) | seq[1:]
        ordered = np.sort(key)
        head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(head, len(ordered)))
        most = int(count.max())
        if most < least:
            break
        top = np.flatnonzero(count >= max(least, most // NEAR_MOST))
        chosen = ordered[head[top[np.argsort(count[top], kind="stable")]]]
        bits = min(max(10, (8 * len(chosen)).bit_length()), 26)
        table = np.full(1 << bits, -1, np.int32)
        table[_slots(chosen, bits)] = np.arange(len(chosen), dtype=np.int32)  # the last, most frequent, stays
        rank = table[_slots(key, bits)]
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        hit = chosen[rank] == key[at]
        at, rank = at[hit], rank[hit]
        run = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, rank = at[even], rank[even]
        used = np.bincount(rank, minlength=len(chosen)) > 0
        named = chosen[used]
        rules.append(np.stack(((named >> kind(half)).astype(np.uint32), (named & kind((1 << half) - 1)).astype(np.uint32)), 1))
        seq[at] = symbols + (np.cumsum(used) - 1)[rank]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        symbols += len(named)
    return base.astype(np.uint32), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq


def write_shard(ids: np.ndarray, doc_ids: list, bounds: np.ndarray, first: int, **how) -> bytes:
    base, rules, seq = compress(ids, **how)
    size = [1] * len(base)
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    wide = 2 if len(base) + len(rules) <= 1 << 16 else 4
    head = np.array([len(doc_ids), len(ids), len(base), len(rules), len(seq), wide, first], "<u8").tobytes()
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    sizes = np.array(size, np.int64)
    marks = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes[seq])))[:-1][::MARK] if len(seq) else np.zeros(0)
    return b"".join((MAGIC, head, base.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), sizes[len(base) :].astype("<u4").tobytes(), names.tobytes(), nulls.tobytes(), bounds[:-1].astype("<u8").tobytes(), marks.astype("<u8").tobytes(), seq.astype(f"<u{wide}").tobytes()))


class Shard:
    """A written shard: its documents, any range of its ids, and all of them. Opening it decodes nothing."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, self.n_ids, n_base, n_rules, n_seq, wide, self.first = (int(x) for x in np.frombuffer(data, "<u8", 7, 8))
        at = 8 + 56

        def read(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.base, self.rules = read("<u4", n_base), read("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_sizes, names, nulls, self.starts = read("<u4", n_rules), read("<i8", docs), read("u1", docs), read("<u8", docs).astype(np.int64)
        self.marks, self.seq = read("<u8", -(-n_seq // MARK)).astype(np.int64), read(f"<u{wide}", n_seq)
        self.doc_ids = [None if z else int(x) for x, z in zip(names, nulls, strict=True)]

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= len(self.base)
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.rule_sizes[symbols[rule] - len(self.base)]
        return out

    def ids(self, start: int, length: int) -> np.ndarray:
        """The ids from `start` on: between two stored places the expansion lengths are added up, and only symbols that cover the range are expanded."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        i, j = int(np.searchsorted(self.marks, start, "right")) - 1, int(np.searchsorted(self.marks, start + length, "left"))
        part = self.seq[i * MARK : j * MARK].astype(np.int64)
        ends = self.marks[i] + np.cumsum(self._sizes(part))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + length, "left")) + 1
        skip, symbols = start - int(ends[a - 1] if a else self.marks[i]), part[a:b]
        while (rule := symbols >= len(self.base)).any():
            width = np.where(rule, 2, 1)
            at = np.cumsum(width) - width
            wider = np.empty(int(width.sum()), np.int64)
            wider[at[~rule]] = symbols[~rule]
            pair = self.rules[symbols[rule] - len(self.base)]
            wider[at[rule]], wider[at[rule] + 1] = pair[:, 0], pair[:, 1]
            symbols = wider
        return self.base[symbols[skip : skip + length]]

    def all_ids(self) -> np.ndarray:
        """All ids, each rule expanded once."""
        made: list[np.ndarray] = [self.base[i : i + 1] for i in range(len(self.base))]
        for a, b in self.rules.tolist():
            made.append(np.concatenate((made[a], made[b])))
        if not len(self.seq):
            return np.zeros(0, np.uint32)
        table, size = np.concatenate(made), self._sizes(self.seq.astype(np.int64))
        begin = np.cumsum([0, *map(len, made)])[self.seq]
        return table[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _shards(vocabulary: str, end: int, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, make, shard, first = TaskContext.get().partitionId(), encoder(vocabulary, False), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close():
            nonlocal shard, first, held
            names = [x for n, _, _ in held for x in n]
            ids = np.concatenate([i for _, i, _ in held])
            counts = np.concatenate([np.diff(b) for _, _, b in held])
            bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
            blob = write_shard(ids, names, bounds, first)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], ["part", "shard", "n_ids", "data"])
            shard, first, held = shard + 1, first + len(ids), []
            return out

        for b in gathered(batches):
            names = b.column("doc_id").to_pylist()
            for at, texts in text_slices(b.column("text")):
                ids, bound = ended(*make.encode(texts), end)
                held.append((names[at : at + len(texts)], ids, bound))
                if sum(len(x) for _, x, _ in held) >= shard_ids:
                    yield close()
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, vocabulary: str, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all rows of docs (doc_id, text) as shards below path, in ascending doc_id order (null first, equal ids by text).

    doc_id is cast to long: a value that is none is an error. A null text is empty; each document has its end id. Very long texts
    are encoded whole, in a shard of their own size. Each range of ids is one partition of shards, (part, shard) ascending. Repeated rows are
    documents each. A table without rows writes no shard.
    """
    modest_batches(docs.sparkSession)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    in_id_order(base).mapInArrow(_shards(vocabulary, end, shard_ids), "part int, shard int, n_ids long, data binary").write.option("compression", "none").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """One row a document from the shards below path: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for before, data in zip(b.column("before").to_pylist(), b.column("data").to_pylist(), strict=True):
                s = Shard(data)
                size = np.diff(np.append(s.starts, s.n_ids))
                ids = s.all_ids().astype("<u4")
                sums = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(s.starts.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(s.starts + s.first + before), pa.array(size), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema("part int, shard int, n_ids long, data binary").parquet(path)
    # one row a partition: its first id's place
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # bounded: a row for each of the partitions that wrote, whose number is a setting
    return shards.join(F.broadcast(before), F.col("part") == F.col("__part")).select("before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark, 'ids').base}/shards"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_ids(spark, path)
