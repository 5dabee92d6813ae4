"""SimHash near-dedup by a generalised pigeonhole (operator 8).

Fingerprints of 64 bits link at `radius` or fewer differing bits. The bits are grouped into partitions (correlated bits
together, from counts over all fingerprints); a dynamic programme gives each partition its own threshold, unequal where that
lowers the estimated number of candidates; thresholds T_i sum to radius - m + 1, so two linked fingerprints agree within
T_i on some partition i (T_i = -1: the partition is not probed). Fingerprints meet under their partition's value and its
variants, candidates are verified by their full distance, and a bucket gives a spanning forest of its links, never all
pairs. Components of the forests are found by alternating star contraction over tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches
from .shared import Scratch, mix64, modest_batches, shuffle_width, text_buffers, text_of, word_spans

BITS = 64
SEED = 42
#: Costs by which the programme weighs one emitted key against one candidate pair.
KEY_COST, PAIR_COST = 60.0, 5.0
_CHUNK = "bucket int, keys binary, fps binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


# ------------------------------------------------------------------------------------------------ fingerprints


def _shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of `size` lower-cased words, joined by one space, and the documents' counts of them."""
    import xxhash

    starts, ends, first = word_spans(raw, offsets)
    n_words = np.diff(first)
    counts = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    low = _LOWER[raw]
    lens = ends - starts
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens + 1)))[:-1]  # in the text with single gaps
    inside = low != 32
    keep = inside.copy()
    tail = ends[ends < len(raw)]
    flat = low
    if len(tail) != len(ends) or int(keep.sum()) + len(ends) != len(raw) or not np.array_equal(at, starts):
        flat = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
        place = np.repeat(at, lens) + (np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens))
        flat[place] = low[inside]
    left = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    right = np.minimum(left + size, np.repeat(first[1:], counts)) - 1
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    a, b = at[left].tolist(), (at[right] + lens[right]).tolist()
    return np.fromiter((digest(data[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a)), counts


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each document: the bits set in over half of its hashes; zero without any."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    a, step = 0, 1 << 16
    while a < len(counts):
        base = int(ends[a] - counts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + step, "right")))
        have = np.flatnonzero(counts[a:b]) + a
        if len(have):
            ones = np.zeros((len(have), BITS), np.int64)
            lo, hi = base, int(ends[b - 1])
            heads = (ends - counts)[have]
            for s in range(lo, hi, step):  # a very long document is summed in pieces
                e = min(s + step, hi)
                bits = np.unpackbits(h[s:e].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, j = int(np.searchsorted(heads, s, "right")) - 1, int(np.searchsorted(heads, e, "left"))
                cuts = np.maximum(heads[i:j], s) - s
                ones[i:j] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
            set_bits = (2 * ones > counts[have][:, None]).astype(np.uint8)
            out[have] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
        a = b
    return out


def fingerprint_column(text, shingle: int = 3):
    """A long whose bits are the fingerprint of the text column."""

    def run(col: pa.Array) -> pa.Array:
        raw, offsets = text_buffers(col)
        out, a, n = [], 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (2 << 20), "right")) - 1)
            part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            h, counts = _shingle_hashes(part, off, shingle)
            out.append(majority(h, counts))
            a = b
        return pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(text)


# ------------------------------------------------------------------------------------------------ partitions and thresholds


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


def _agreement(p: np.ndarray, t: int) -> float:
    """Chance that two fingerprints differ in t or fewer of bits that are one with chances p."""
    if t < 0:
        return 0.0
    chances = np.zeros(t + 1)
    chances[0] = 1.0
    for x in 2 * p * (1 - p):
        chances[1:] = chances[1:] * (1 - x) + chances[:-1] * x
        chances[0] *= 1 - x
    return float(chances.sum())


def plan_partitions(n: int, ones: np.ndarray, both: np.ndarray, radius: int) -> list[Part]:
    """Partitions and thresholds of least estimated cost for n fingerprints, given counts of set bits and of pairs of them.

    From one partition to radius + 1 of them are tried, each with every threshold up to its size.
    """
    if not 0 <= radius <= BITS:
        raise ValueError(f"radius must be from 0 to {BITS}")
    n = max(n, 1)
    p = ones / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    best = (float("inf"), [])
    for m in range(1, min(radius + 1, BITS) + 1):
        free, groups = np.ones(BITS, bool), []
        for k in range(m):
            size = (BITS - sum(map(len, groups))) // (m - k)
            pull, group = corr @ free - np.diag(corr), []
            while len(group) < size:  # the most correlated bit joins, the first of equals
                bit = int(np.argmax(np.where(free, pull, -1.0)))
                pull = corr[bit].copy() if not group else pull + corr[bit]
                group.append(bit)
                free[bit] = False
            groups.append(tuple(sorted(group)))

        def cost(g, t):
            if t < 0:
                return 0.0
            # both sides give their variants within half the threshold, rounded up, so an odd one costs as the even one above
            half = (t + 1) // 2
            return KEY_COST * n * sum(comb(len(g), i) for i in range(half + 1)) + PAIR_COST * 0.5 * n * n * _agreement(p[list(g)], 2 * half)

        total = radius - m + 1
        table = {0: (0.0, [])}  # threshold sum so far, each counted from -1
        for g in groups:
            nxt: dict = {}
            for s, (c, ts) in table.items():
                for t in range(-1, len(g) + 1):
                    if (s2 := s + t + 1) <= total + m and ((v := c + cost(g, t)) < nxt.get(s2, (float("inf"),))[0]):
                        nxt[s2] = (v, [*ts, t])
            table = nxt
        if total + m in table and table[total + m][0] < best[0]:
            best = (table[total + m][0], [Part(g, t) for g, t in zip(groups, table[total + m][1], strict=True)])
    return best[1]


def _masks(bits: tuple[int, ...], up_to: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(up_to + 1) for c in combinations(bits, k)], np.uint64)


def keys_of(fps: np.ndarray, parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) arrays under which fingerprints meet; a key is 32 bits, for candidates are verified anyway."""
    keys, n = [], 0
    with np.errstate(over="ignore"):
        for k, part in enumerate(parts):
            if part.threshold < 0:
                continue
            mask = np.uint64(sum(1 << b for b in part.bits))
            for flip in _masks(part.bits, (part.threshold + 1) // 2):
                keys.append((mix64(((fps ^ flip) & mask) + np.uint64(k + 1) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32))
                n += 1
    return np.concatenate(keys) if keys else np.zeros(0, np.uint32), np.tile(np.arange(len(fps)), n)


# ------------------------------------------------------------------------------------------------ links within buckets


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, by hooking to lesser labels and jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        a, b = a[apart], b[apart]
    return label


def _visit(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components among distinct fingerprints: each visit takes all it reaches out of the rest."""
    left, src, dst = np.arange(len(fps)), [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
        if near.any():
            got = left[near]
            src.append(np.full(len(got), x))
            dst.append(got)
            queue.extend(got.tolist())
            left = left[~near]
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spread(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket: fingerprints within radius agree on one of radius + 1 slices exactly, so those of equal slices are visited."""
    src, dst = [], []
    for slice_bits in np.array_split(np.arange(BITS), radius + 1):
        mask = np.uint64(sum(1 << int(b) for b in slice_bits))
        value = fps & mask
        order = np.argsort(value, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1], [True])))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1:
                at = order[i:j]
                s, d = _visit(fps[at], radius)
                src.append(at[s])
                dst.append(at[d])
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, lesser fingerprint), of the links among fingerprints that share a key; few under a key are compared pair by pair."""
    nodes, at = np.unique(fps, return_inverse=True)
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
    keys, at = keys[fresh], at[fresh]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    sizes = np.diff(cut)
    src, dst = [], []
    small = (sizes > 1) & (sizes <= 64)
    for size in np.unique(sizes[small]):
        groups = cut[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        for g in range(0, len(groups), max(1, (1 << 20) // len(i))):
            base = groups[g : g + max(1, (1 << 20) // len(i))][:, None]
            x, y = at[base + i].ravel(), at[base + j].ravel()
            near = np.bitwise_count(nodes[x] ^ nodes[y]) <= radius
            src.append(x[near])
            dst.append(y[near])
    for k in np.flatnonzero(sizes > 64):
        who = at[cut[k] : cut[k + 1]]
        s, d = _spread(nodes[who], radius)
        src.append(who[s])
        dst.append(who[d])
    if not src:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    label = components(len(nodes), np.concatenate(src), np.concatenate(dst))
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _deal(parts: list[Part], buckets: int):
    def run(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fps), 20_000):
                keys, at = keys_of(fps[a : a + 20_000], parts)
                bucket = keys % np.uint32(buckets)
                order = np.argsort(bucket, kind="stable")
                keys, who, bucket = keys[order], fps[a + at[order]], bucket[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(k, keys[i:j].tobytes(), who[i:j].tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "fps"])

    return run


def _meet(radius: int):
    def run(batches):
        keys, fps = [], []
        for b in batches:
            for r in b.to_pylist():
                keys.append(np.frombuffer(r["keys"], np.uint32))
                fps.append(np.frombuffer(r["fps"], np.uint64))
        if keys:
            x, y = bucket_links(np.concatenate(keys), np.concatenate(fps), radius)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def _bit_counts(batches):
    """Of all fingerprints of this partition: how many have bits i and j both set, for i <= j."""
    total = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        for a in range(0, len(fps), 1 << 16):
            bits = np.unpackbits(np.ascontiguousarray(fps[a : a + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i * BITS + j), pa.array(total[i, j])], ["at", "n"])


# ------------------------------------------------------------------------------------------------ components


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, root) for every node of edges (a, b): alternating large and small stars until no edge moves.

    Each step is a grouped minimum and a join back on the node; tables are written between steps. A node of many links is
    a grouped minimum of many rows, pre-aggregated before the exchange; minima are written before they are joined, so that the join is
    of two plain exchanges, whose large partitions the engine splits.
    """
    ordered = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, seen = scratch.write(ordered(edges)), None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is the least of all its neighbours keeps them
        large = scratch.write(ordered(large))
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = large.join(low, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        current = scratch.write(ordered(small))
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            return current.select("a", F.col("b").alias("root"))
        seen = mark


def _own(docs: DataFrame):
    """(absent, doc_id, row): a null id only stands for a group without any other."""
    return F.struct(docs["doc_id"].isNull().alias("absent"), docs["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("row"))


def _named(classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, least) of classes (fp, least): the least row of all that links (a, b) reach."""
    roots = connected(links, scratch)
    # every linked fingerprint with its root; the root itself included
    member = roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct())
    # written before it is joined: a component of a third of all rows is then split by the engine
    first = scratch.write(member.join(classes, F.col("a") == F.col("fp")).groupBy("root").agg(F.min("least").alias("first")))
    linked = member.join(first, "root").select("a", "first")
    return scratch.write(classes.join(linked, F.col("a") == F.col("fp"), "left").select("fp", F.coalesce("first", "least").alias("least")))


def one_of_each_group(docs: DataFrame, least: float = 2 / 3, radius: int = 3) -> DataFrame:
    """docs without near duplicates: of each component the row of the least doc_id stays, one row even where rows repeat.

    Texts are compared as sets of five-word shingles (module sketches). They meet by their SimHash fingerprints of these shingles (within `radius` bits,
    by the search of this module) or by bands of least hashes, as fingerprints alone lose pairs of similarity 0.8; every pair
    that meets is checked. It is linked if the sketches put the sets' Jaccard similarity at `least` or more: two thirds
    mean a cosine, which is what fingerprints stand for, of at least 0.8. The estimate's standard deviation is 0.04. Texts without words are
    copies of each other. A null doc_id stays where its group has no other. Very long texts are one set each. A table without rows gives none.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    scratch, n = Scratch(spark, "near"), max(shuffle_width(spark), 2)
    doc = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    printed = scratch.write(docs.select(_own(docs).alias("own"), doc, sketches.sketch_column(text_of(docs)).alias("s")))
    # a class is a set of shingles: its rows have equal sketches
    firsts = [F.first(f"s.{c}").alias(c) for c in ("print", "bands", "sketch")]
    classes = scratch.write(printed.groupBy(F.col("s.fp").alias("fp")).agg(F.min("own").alias("least"), *firsts))
    parts = _planned(classes.select(F.col("print").alias("fp")), radius)
    links = scratch.write(sketches.linked(classes.repartition(n), n, parts, radius, least))
    stays = _named(classes.select("fp", "least"), links, scratch).select("least.row").distinct()
    return printed.join(stays.hint("shuffle_hash"), F.col("own.row") == F.col("row"), "left_semi").select("doc.*")


def _planned(prints: DataFrame, radius: int) -> list[Part]:
    """Partitions and thresholds for fingerprints (fp), from counts over all of them."""
    counts = prints.mapInArrow(_bit_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in counts:
        i, j = divmod(r["at"], BITS)
        both[i, j] = both[j, i] = r["n"]
    return plan_partitions(prints.count(), np.diag(both).copy(), both, radius)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored) as doc_id, fp (long) and component_id.

    component_id is the least doc_id that links reach (nulls are no candidates for it while any other id is there). A null
    or empty text has fingerprint zero and links like any other. Repeated rows share a fingerprint, hence a component. Very long
    texts are summed in pieces. Tables without rows give none. Fingerprints are made distinct before the search, so copies cost nothing there.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    scratch, n = Scratch(spark, "simhash"), max(shuffle_width(spark), 2)
    printed = scratch.write(docs.select(_own(docs).alias("own"), fingerprint_column(text_of(docs), shingle).alias("fp")))
    classes = scratch.write(printed.groupBy("fp").agg(F.min("own").alias("least")))
    parts = _planned(classes.select("fp"), radius)
    links = scratch.write(classes.select("fp").repartition(n).mapInArrow(_deal(parts, n), _CHUNK).repartitionById(n, F.col("bucket")).mapInArrow(_meet(radius), "a long, b long"))
    named = _named(classes, links, scratch)
    named = named.select(F.col("fp").alias("__fp"), F.col("least.doc_id").alias("component_id"))
    return printed.join(named, F.col("fp") == F.col("__fp")).select("own.doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
