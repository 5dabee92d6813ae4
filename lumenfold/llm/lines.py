"""Quality classifier: a linear-chain conditional random field over the lines of a text (operator 1).

Every line is good or bad. A line's potential is linear in its own features and those of the lines before and after it;
transition weights join neighbours. Forward-backward gives each line's marginal; a document's score is their mean weighted
by line length. Document labels teach: all lines of a labelled document carry its label.

The fit takes a bounded sample, FIT_DOCS labelled ids (smallest hashes first), and of each all lines of the whole text; chains of
over CHAIN lines are taught in pieces of that many, whose end lines still see their neighbours' features. Nothing else is bounded, and every
whole text is scored as one chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, modest_batches, text_buffers, text_of, word_hashes, word_spans

FIT_DOCS = 4000
CHAIN = 64
#: Box of the transition weights: labels never change within a taught document, so likelihood alone would raise them without end.
STAY = 1.5
SLICE = 2 << 20
#: Byte classes that are counted in a line.
CLASSES = {
    "symbol": b"#*$%&|<>@~^_=+\\{}[]",
    "loud": b"!?",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
}
OWN = (*(f"{k}_share" for k in CLASSES), "wide_share", "log_chars", "log_words", "word_chars", "echo_share", "ends_closed", "seen_before", "empty")


def _class_tables() -> np.ndarray:
    out = np.zeros((len(CLASSES) + 1, 256), np.uint8)
    for i, members in enumerate(CLASSES.values()):
        out[i, list(members)] = 1
    out[-1, 128:] = 1
    return out


_TABLES = _class_tables()


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, counts): own features of each line, its bytes, and each document's number of lines (at least one)."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    per_doc = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    counts = per_doc + 1
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    starts = np.empty(first[-1], np.int64)
    heads = np.zeros(first[-1], bool)
    heads[first[:-1]] = True
    starts[heads] = offsets[:-1]
    starts[~heads] = breaks + 1
    ends = np.empty_like(starts)
    tails = np.zeros(first[-1], bool)
    tails[first[1:] - 1] = True
    ends[tails] = offsets[1:]
    ends[~tails] = breaks
    size = ends - starts

    def per_line(values: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
        return sums[to] - sums[at]

    x = np.zeros((len(OWN), len(starts)), np.float32)
    some = np.maximum(size, 1)
    for k in range(len(_TABLES)):
        x[k] = per_line(_TABLES[k][raw], starts, ends) / some
    ws, we, _ = word_spans(raw, offsets)
    wh = word_hashes(raw, ws, we)
    a, b = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = b - a
    echo = np.zeros(len(wh), np.int64)
    echo[1:] = wh[1:] == wh[:-1]
    echo[a[words > 0]] = 0  # a line's first word
    k = len(_TABLES)
    x[k] = np.log1p(size)
    x[k + 1] = np.log1p(words)
    x[k + 2] = per_line(we - ws, a, b) / np.maximum(words, 1) / 8.0
    x[k + 3] = per_line(echo, a, b) / np.maximum(words, 1)
    last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(len(ends), np.uint8)
    x[k + 4] = (size > 0) & np.isin(last, list(b".!?:\"'"))
    with np.errstate(over="ignore"):
        # a line is its words in their places
        place = (np.arange(len(wh)) - np.repeat(a, words)).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(wh * (place * np.uint64(2) + np.uint64(3))), dtype=np.uint64)))
    key = (sums[b] - sums[a]) + words.astype(np.uint64)
    doc = np.repeat(np.arange(n_docs), counts)
    order = np.lexsort((key, doc))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    seen = np.zeros(len(key), bool)
    seen[order] = same
    x[k + 5] = seen & (words > 0)
    x[k + 6] = words == 0
    return x.T, size, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and the line after (zero outside the document), and a constant."""
    n, w = own.shape
    out = np.zeros((n, 3 * w + 1), np.float32)
    out[:, :w] = own
    ends = np.cumsum(counts)
    out[1:, w : 2 * w] = own[:-1]
    out[:-1, 2 * w : 3 * w] = own[1:]
    out[ends - counts, w : 2 * w] = 0
    out[ends - 1, 2 * w : 3 * w] = 0
    out[:, -1] = 1
    return out


def marginals(odds: np.ndarray, counts: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good for each line, and expected counts of label pairs over all chains (times the chain's weight), by scaled forward-backward.

    odds: log potentials of good over bad. Chains go longest first, so that each step is one slice of those still going.
    """
    order = np.argsort(-counts, kind="stable")
    at = (np.cumsum(counts) - counts)[order]
    c = counts[order]
    each = np.ones(len(counts)) if weight is None else weight[order]
    steps = int(c[0]) if len(c) else 0
    live = np.searchsorted(-c, -np.arange(steps), "left")  # chains with more than t lines
    t = np.exp(trans)
    odds = np.clip(odds, -40, 40)
    e1, e0 = np.exp(np.minimum(odds, 0)), np.exp(np.minimum(-odds, 0))
    f = np.empty((len(odds), 2))
    for s in range(steps):
        i = at[: live[s]] + s
        if s:
            p = f[i - 1]
            a0, a1 = p[:, 0] * t[0, 0] + p[:, 1] * t[1, 0], p[:, 0] * t[0, 1] + p[:, 1] * t[1, 1]
        else:
            a0 = a1 = np.ones(len(i))
        a0, a1 = a0 * e0[i], a1 * e1[i]
        z = a0 + a1
        f[i, 0], f[i, 1] = a0 / z, a1 / z
    good = np.empty(len(odds))
    pairs = np.zeros((2, 2))
    b = np.ones((len(c), 2))
    for s in range(steps - 1, -1, -1):
        i = at[: live[s]] + s
        m = f[i] * b[: live[s]]
        good[i] = m[:, 1] / m.sum(1)
        if s:
            e = np.stack((e0[i], e1[i]), 1) * b[: live[s]]
            joint = f[i - 1][:, :, None] * t[None] * e[:, None, :]
            pairs += (joint * (each[: live[s]] / joint.sum((1, 2)))[:, None, None]).sum(0)
            nb = e @ t.T
            b[: live[s]] = nb / nb.sum(1, keepdims=True)
    return good, pairs


@dataclass
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    shift: float = 0.0

    def odds(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.scale, counts) @ self.weights

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score for each document: marginals weighted by line length."""
        own, size, counts = line_features(raw, offsets)
        good, _ = marginals(self.odds(own, counts), counts, self.trans)
        weight = np.maximum(size, 1).astype(np.float64)
        heads = np.cumsum(counts) - counts
        if not len(counts):
            return np.zeros(0)
        return np.clip(np.add.reduceat(good * weight, heads) / np.add.reduceat(weight, heads), 0.0, 1.0)


def pieces(counts: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, document) of chains cut into runs of at most `size` lines."""
    n = -(-counts // size)
    doc = np.repeat(np.arange(len(counts)), n)
    last = np.cumsum(n) - 1
    out = np.full(int(n.sum()), size, np.int64)
    out[last] = counts - (n - 1) * size
    return out, doc


def loss(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float, w: np.ndarray, trans: np.ndarray) -> float:
    """What the fit makes least: the negative log likelihood of chains whose lines all carry the chain's label, each times its weight, and a ridge."""
    odds = np.clip(x @ w, -40, 40)
    own = np.add.reduceat(odds * np.repeat(labels, counts), np.cumsum(counts) - counts) + (counts - 1) * np.where(labels == 1, trans[1, 1], trans[0, 0])
    return float((weight * (partition(odds, counts, trans) - own)).sum() + 0.5 * ridge * ((w**2).sum() + (trans**2).sum()))


def gradient(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Of the loss, by w and then trans: expected less observed features and label pairs."""
    good, pairs = marginals(x @ w, counts, trans, weight)
    steps = weight * (counts - 1)
    seen = np.diag([steps[labels == 0].sum(), steps[labels == 1].sum()])
    return np.concatenate((x.T @ (np.repeat(weight, counts) * (good - np.repeat(labels, counts))) + ridge * w, (pairs - seen + ridge * trans).ravel()))


def partition(odds: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The log of the sum over all labellings of each chain."""
    order = np.argsort(-counts, kind="stable")
    at, c = (np.cumsum(counts) - counts)[order], counts[order]
    live = np.searchsorted(-c, -np.arange(int(c[0]) if len(c) else 0), "left")
    a = np.zeros((len(c), 2))
    for s, n in enumerate(live):
        i = at[:n] + s
        if s:
            a[:n] = np.logaddexp(a[:n, :1] + trans[None, 0], a[:n, 1:] + trans[None, 1])
        a[:n, 1] += odds[i]
    out = np.empty(len(c))
    out[order] = np.logaddexp(a[:, 0], a[:, 1])
    return out


def fit(own: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> LineModel:
    """Maximum conditional likelihood by Adam within the transitions' box; each document counts once whatever its lines, both classes alike.

    Without both classes the model says the one label, or 0.5.
    """
    width = 3 * len(OWN) + 1
    if not len(labels) or labels.min() == labels.max():
        w = np.zeros(width)
        w[-1] = 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
        return LineModel(np.zeros(len(OWN), np.float32), np.ones(len(OWN), np.float32), w, np.zeros((2, 2)))
    mean, scale = own.mean(0), np.maximum(own.std(0), 1e-3)
    x = with_neighbours((own - mean) / scale, counts).astype(np.float64)
    chains, doc = pieces(counts)
    share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean()) / len(labels)
    weight = (share / counts)[doc]
    at = np.concatenate((np.zeros(width), [0.5, 0.0, 0.0, 0.5]))
    m1, m2 = np.zeros(width + 4), np.zeros(width + 4)
    for r in range(1, rounds + 1):
        step = gradient(x, chains, labels[doc], weight, ridge, at[:width], at[width:].reshape(2, 2))
        m1, m2 = 0.9 * m1 + 0.1 * step, 0.99 * m2 + 0.01 * step**2
        at = at - 0.1 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
        at[width:] = np.clip(at[width:], -STAY, STAY)
    return LineModel(mean, scale, at[:width], at[width:].reshape(2, 2))


def _sampled(batches):
    """All lines' features of each sampled text, packed as half floats."""
    for b in batches:
        raw, offsets = text_buffers(b.column("text"))
        rows = []
        for d, y in enumerate(b.column("y").to_pylist()):
            own, _, _ = line_features(raw[offsets[d] : offsets[d + 1]], np.array([0, offsets[d + 1] - offsets[d]]))
            rows.append((y, np.ascontiguousarray(own, np.float16).tobytes()))
        if rows:
            y, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.binary())], ["y", "x"])


def in_held_out(doc_id):
    """The fold that is never learnt from; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> LineModel:
    """Fits on at most fit_docs labelled ids outside the held-out fold (a label that several rows contradict goes by their mean; nulls are no labels)."""
    modest_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.avg("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    ids = ids.select(F.col("doc_id").alias("__id"), F.col("q"))
    text = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    # rows of one id are one example: the longest text, of equally long ones the last by its characters
    rows = text.groupBy("doc_id").agg(F.first("q").alias("q"), F.max(F.struct(F.length("text").alias("n"), "text")).alias("t"))
    rows = rows.select((F.col("q") >= 0.5).cast("int").alias("y"), F.col("t.text").alias("text")).mapInArrow(_sampled, "y int, x binary").collect()
    rows = sorted(((r["y"], bytes(r["x"])) for r in rows), key=lambda r: (r[1], r[0]))
    own = [np.frombuffer(x, np.float16).astype(np.float32).reshape(-1, len(OWN)) for _, x in rows]
    return fit(np.concatenate(own) if own else np.zeros((0, len(OWN)), np.float32), np.array([len(x) for x in own], np.int64), np.array([y for y, _ in rows], np.int64))


def score_column(model: LineModel, text):
    def run(col: pa.Array) -> pa.Array:
        raw, offsets = text_buffers(col)
        out, a, n = [np.zeros(0)], 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            out.append(model.scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            a = b
        return pa.array(np.concatenate(out))

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text)


def line_marginals(docs: DataFrame, model: LineModel) -> DataFrame:
    """One row a line of docs (doc_id, text): doc_id, line (from 0), start and size (bytes in the text), good (its marginal). Null texts are one empty line."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            a, n = 0, b.num_rows
            while a < n:
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
                own, size, counts = line_features(raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                good, _ = marginals(model.odds(own, counts), counts, model.trans)
                first = np.repeat(np.cumsum(counts) - counts, counts)
                begin = np.cumsum(size + 1) - size - 1
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.repeat(np.arange(a, z), counts))), pa.array(np.arange(len(good)) - first), pa.array(begin - begin[first]), pa.array(size), pa.array(good)], ["doc_id", "line", "start", "size", "good"])
                a = z

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, line long, start long, size long, good double")


def line_quality(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted.

    A null text is empty; an empty text is one empty line and scored like any other. Equal texts score alike, repeated rows each by
    itself. A very long text is one chain, scored whole. A null doc_id is in no held-out fold and teaches nothing. Without labels every score
    is 0.5. Tables without rows give none.
    """
    model = train(docs, labels, fit_docs)
    out = docs.select("doc_id", in_held_out(docs["doc_id"]).alias("held_out"), score_column(model, text_of(docs)).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def only_good(docs: DataFrame, labels: DataFrame, taught_by: DataFrame | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """docs, all columns, without the rows whose score is under 0.5; the labels are of taught_by, or of docs."""
    model = train(docs if taught_by is None else taught_by, labels, fit_docs)
    return docs.where(score_column(model, text_of(docs)) >= 0.5)


def query(spark, sf_dir: str) -> DataFrame:
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
