"""Packing token ids into fixed windows by minimum bin slack (operator 5).

A document longer than the window is cut into full windows; what is over joins a pool of tails. Each window takes the tail that has waited
longest and, of the pool's lengths, the multiset that fills the rest closest: a subset-sum programme over bitsets, longest lengths first, with the
counts found by walking its layers back; of one length the tails that have waited longest go. Where even the best leaves slack, a further tail is cut to fill it.
The last tokens of a partition, fewer than a window, are laid into sequences whose lengths are powers of two, which need no padding.

A pool holds at most POOL tails, so memory is bounded for any input, "closest" is of the pool, and sequences come in the order of
the documents up to a pool; partitions are packed independently.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, text_of
from .tokens import CACHE, encoder, gathered, text_slices

WINDOW = 1024
END = 0
POOL, LOW = 1024, 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (with at most the given counts) whose sum comes closest to room without passing it."""
    reach, full, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x]), reverse=True):
        before, copies, step = reach, min(counts[length], room // length), 1
        while copies:  # 1, 2, 4, ... copies at a time
            take = min(step, copies)
            reach |= (reach << (take * length)) & full
            copies -= take
            step *= 2
        layers.append((length, before))
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        k = 0
        while not before >> at & 1:
            at -= length
            k += 1
        if k:
            chosen[length] = k
    return chosen


class Packer:
    """Takes documents' ids and gives pieces with their place. A tail is (doc_id, start, ids, doc_tokens), known in the pool by its number."""

    def __init__(self, window: int, part: int):
        self.window, self.next = window, part << 33
        self.pool: dict[int, deque] = defaultdict(deque)
        self.tails: dict[int, tuple] = {}
        self.waiting: deque[int] = deque()
        self.number = 0
        self.counts: dict[int, int] = {}
        self.size = self.total = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        cut = n - n % self.window
        for a in range(0, cut, self.window):
            self._emit([(doc_id, a, ids[a : a + self.window], n)])
        if n > cut:
            self._put((doc_id, cut, ids[cut:].copy(), n))
        if self.size >= POOL:
            self._windows(LOW)

    def finish(self) -> None:
        self._windows(0)
        rest = [self._take(length) for length in sorted(self.counts, reverse=True) for _ in range(self.counts[length])]
        left = self.total_of(rest)
        while left:
            room, row = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                piece = rest.pop(0)
                if len(piece[2]) > room:
                    piece, over = self._cut(piece, room)
                    rest.insert(0, over)
                row.append(piece)
                room -= len(piece[2])
            self._emit(row)

    @staticmethod
    def total_of(pieces) -> int:
        return sum(len(p[2]) for p in pieces)

    @staticmethod
    def _cut(piece, n: int):
        doc_id, start, ids, tokens = piece
        return (doc_id, start, ids[:n], tokens), (doc_id, start + n, ids[n:], tokens)

    def _put(self, piece, again: bool = False) -> None:
        """A tail joins; what is over of one that was cut goes first again."""
        n = len(piece[2])
        self.number += 1
        self.tails[self.number] = piece
        (self.pool[n].appendleft if again else self.pool[n].append)(self.number)
        (self.waiting.appendleft if again else self.waiting.append)(self.number)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.size += 1
        self.total += n

    def _out_of_pool(self, number: int):
        piece = self.tails.pop(number)
        n = len(piece[2])
        self.counts[n] -= 1
        self.size -= 1
        self.total -= n
        return piece

    def _take(self, n: int):
        """The tail of n ids that has waited longest."""
        while (number := self.pool[n].popleft()) not in self.tails:
            pass
        return self._out_of_pool(number)

    def _oldest(self):
        while (number := self.waiting.popleft()) not in self.tails:
            pass
        return self._out_of_pool(number)

    def _windows(self, low: int) -> None:
        """Full windows until the pool holds `low` tails or fewer ids than a window."""
        while self.size > low and self.total >= self.window:
            self.counts = {k: c for k, c in self.counts.items() if c}
            row = [self._oldest()]
            chosen = fill(self.counts, self.window - len(row[0][2]))
            for length, k in chosen.items():
                row += [self._take(length) for _ in range(k)]
            if slack := self.window - self.total_of(row):
                piece, over = self._cut(self._take(max(k for k, c in self.counts.items() if c)), slack)
                row.append(piece)
                self._put(over, again=True)
            self._emit(row)

    def _emit(self, row: list) -> None:
        offset = 0
        for doc_id, start, ids, tokens in row:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def flush(self):
        if self.out:
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.out, strict=True)], names)
            self.out = []


def ended(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with `end` after each document's, and the bounds of documents in them."""
    bound = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts + 1)))
    out = np.full(int(bound[-1]), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[bound[1:] - 1] = False
    out[keep] = ids
    return out, bound


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, spaced: bool = True, cache: int = CACHE) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text; other columns are ignored): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its one id is the end id. Rows of equal doc_id are documents of their own. A null doc_id stays null; doc_id is cast
    to long, a value that is none is an error. A very long text is encoded by itself and cut into windows.
    Tables without rows give no pieces. sequence_id holds the partition in its upper bits; a rerun of a lost task makes the
    same pieces, for a partition's rows and order are those of its input split. cache bounds the pieces whose ids a worker remembers.
    """

    modest_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        make, packer = encoder(vocabulary, spaced, cache), Packer(window, TaskContext.get().partitionId())
        for b in gathered(batches):
            names = b.column("doc_id").to_pylist()
            for first, texts in text_slices(b.column("text")):
                ids, bound = ended(*make.encode(texts), end)
                for k in range(len(texts)):
                    packer.add(names[first + k], ids[bound[k] : bound[k + 1]])
                yield from packer.flush()
        packer.finish()
        yield from packer.flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
