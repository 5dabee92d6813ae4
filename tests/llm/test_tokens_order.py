"""Operators 1, 2, 3, 5 and 7."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import grammar, lines, mixing, packing, shards, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  a  b", "a\tb", " x", "x ", "a\n\nb", "a \n b", "<|endoftext|> hi", "it's we'll 123abc ÀÉ b", "ＤF x²  ", "Σας ΣΑΣ", "é cafe\u0301", "\n", "a\nb\nc", "Œuvre œ", "a\xa0b", "l'été DON'T, don't.", "x... y!!! .,; 3.14 a.b,c", None, "İstanbul", "a\u2028b", "zero\u200bwidth", "日本 語", "one", "One, one. ONE! one"]


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_encoding_equals_the_library(path, spaced):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcAB ,.!'1é\n") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    made = tokens.Encoder(path, spaced, cache=50)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        ids, counts = [], []
        for _, part in tokens.text_slices(pa.array(texts), 200):
            a, b = made.encode(part)
            ids += a.tolist()
            counts += b.tolist()
        assert counts == [len(w) for w in want] and ids == [x for w in want for x in w]


def test_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 100)
        best = {0}
        for k, c in counts.items():
            best |= {s + k * i for s in best for i in range(c + 1) if s + k * i <= room}
        got = packing.fill(counts, room)
        assert all(got[k] <= counts[k] for k in got) and sum(k * n for k, n in got.items()) == max(best)


def test_pieces_cover_and_fill(messy):
    rows = packing.pack(messy, BYTES).collect()
    lib = Tokenizer.from_file(BYTES)
    want = collections.Counter()
    for r in messy.collect():
        want[r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids) + (0,)] += 1
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for (doc_id, ids), n in want.items():
        pieces = sorted(by[doc_id], key=lambda r: r.start)
        assert sum(p.length for p in pieces) == n * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024 and end & (end - 1) == 0  # full windows and powers of two need no padding


def test_equal_lengths_are_cut_to_fill():
    p = packing.Packer(1024, 0)
    for i in range(50):
        p.add(i, np.full(1000, i, np.uint32))
    p.finish()
    total = collections.Counter()
    for _, _, n, _, _, seq, _ in p.out:
        total[seq] += n
    assert sum(total.values()) == 50_000 and sum(n == 1024 for n in total.values()) == 50_000 // 1024


def expanded(base, rules, seq):
    out = []
    for x in seq.tolist():
        stack = [x]
        while stack:
            y = stack.pop()
            if y < len(base):
                out.append(int(base[y]))
            else:
                stack += reversed(rules[y - len(base)].tolist())
    return out


def test_sequences_keep_the_order_of_documents_up_to_a_pool():
    """Documents of two kinds, dealt one to three; the kinds' shares of tokens hold in every stretch of sequences, and none waits for long."""
    rng = random.Random(2)
    p = packing.Packer(1024, 0)
    for i in range(40_000):
        p.add(i, np.full(rng.choice([700, 900, 1000]) if i % 4 == 0 else rng.randint(5, 400), i % 4 == 0, np.uint32))
    p.finish()
    rows = p.out
    by_seq = collections.defaultdict(collections.Counter)
    for doc_id, _, n, _, _, seq, _ in rows:
        by_seq[seq][doc_id % 4 == 0] += n
    seqs = sorted(by_seq)
    total = sum((by_seq[s] for s in seqs), collections.Counter())
    share = total[True] / total.total()
    for a in range(0, len(seqs) - 1000, 1000):
        part = sum((by_seq[s] for s in seqs[a : a + 1000]), collections.Counter())
        assert abs(part[True] / part.total() - share) < 0.08
    assert all(c.total() == 1024 for s, c in by_seq.items() if s < seqs[-12])
    first = {}
    for doc_id, *_, seq, _ in rows:
        first.setdefault(doc_id, seq)
    late = [first[i] / len(seqs) - i / 40_000 for i in first]
    assert max(map(abs, late)) < 0.25


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49_408, 30)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), np.full(1000, 7, np.uint32), np.concatenate([phrase, rng.integers(0, 500, 2000), phrase, phrase] * 20).astype(np.uint32), rng.integers(0, 300_000, 90_000).astype(np.uint32)):
        cut = np.array([0, len(ids) // 3, len(ids)])
        s = grammar.Shard(grammar.write_shard(ids, [4, None], cut, 11))
        assert (s.ids(0, len(ids)) == ids).all() and s.first == 11 and s.doc_ids == [4, None] and (s.all_ids() == ids).all()
        for _ in range(30):
            a = int(rng.integers(0, len(ids) + 1))
            n = int(rng.integers(0, len(ids) - a + 1))
            assert (s.ids(a, n) == ids[a : a + n]).all()
        if len(ids) == 41_800:
            assert len(s.seq) < len(ids) / 4 and len(s.rules)


@pytest.mark.parametrize("least", [2, 8])
def test_grammar_leaves_no_frequent_pair(least):
    """A phrase of 64 ids found 4096 times, runs of one id, and noise: every rule expands to what it stood for, no pair is left."""
    rng = np.random.default_rng(2)
    phrase = rng.permutation(64)
    for ids in (np.tile(phrase, 4096), np.full(5000, 3), np.concatenate([np.concatenate((phrase, rng.integers(0, 200, 20))) for _ in range(300)])):
        base, rules, seq = grammar.compress(ids.astype(np.uint32), least)
        assert expanded(base, rules, seq) == ids.tolist()
        pairs = collections.Counter()
        last = None
        for x in zip(seq.tolist(), seq.tolist()[1:]):  # occurrences that do not overlap
            if x == last:
                last = None
                continue
            pairs[x] += 1
            last = x if x[0] == x[1] else None
        assert max(pairs.values(), default=0) < least
    assert len(grammar.compress(np.tile(phrase, 4096).astype(np.uint32), 8)[2]) <= 8


def test_written_ids_come_back(spark, messy, tmp_path):
    path = str(tmp_path / "ids")
    grammar.write_ids(messy, WORDS, path, shard_ids=500)
    lib = Tokenizer.from_file(WORDS)
    order = sorted(messy.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(grammar.read_ids(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for r, g in zip(order, got, strict=True):
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_ids_of_one_shared_doc_id(spark, tmp_path):
    """Most rows have one id or none: their ranges are cut again by their texts, the order stays settled."""
    from lumenfold.llm.shared import in_id_order

    rng = random.Random(1)
    rows = [(7 if i % 2 else None if i % 4 else i, " ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(0, 30)))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = in_id_order(docs, 20).rdd.glom().map(len).collect()
    assert sum(parts) == 2000 and max(parts) < 300 and len(parts) >= 20
    flat = [r.doc_id for r in in_id_order(docs, 20).collect()]
    assert flat == sorted(flat, key=lambda x: (x is not None, x or 0))
    path = str(tmp_path / "ids")
    grammar.write_ids(docs, WORDS, path)
    got = sorted(grammar.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == flat and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    lib = Tokenizer.from_file(WORDS)
    sums = lambda ids: zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((i, sums(lib.encode(t, add_special_tokens=False).ids)) for i, t in rows)


def test_ids_of_empty_table(spark, none, tmp_path):
    path = str(tmp_path / "ids")
    grammar.write_ids(none, WORDS, path)
    assert grammar.read_ids(spark, path).count() == 0 and packing.pack(none, BYTES).count() == 0


def earliest_deadline_first(blocks, weights):
    """Every slot looks at every source: the released block of earliest deadline, by exact fractions."""
    left, slots, starts, slot = dict(blocks), {k: [] for k in blocks}, [], 0
    while any(left.values()):
        begun, total, done = slot, sum(weights[k] for k in left if left[k]), dict.fromkeys(left, 0)
        starts.append(begun)
        while True:
            share = {k: Fraction(weights[k], total) for k in left if left[k]}
            ready = [k for k in share if math.floor(done[k] / share[k]) <= slot - begun]
            k = min(ready, key=lambda k: (math.ceil((done[k] + 1) / share[k]), -weights[k], k is not None, k or ""))
            slots[k].append(slot)
            done[k], left[k], slot = done[k] + 1, left[k] - 1, slot + 1
            if not left[k]:
                break
    return slots, starts


TINY = {"big": "0.9995", **{f"tiny{i}": "0.0001" for i in range(5)}}
WEIGHTS = [{"a": 5, "b": 3, "c": 2}, {"a": "0.998", "b": "0.001", "c": "0.001"}, {"a": 1, "b": 1, "c": 1, None: 2}, TINY, {"a": 0.7, "b": "0.30000001"}, {f"s{i}": i * i + 1 for i in range(30)}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_schedule_is_earliest_deadline_first(weights):
    whole, rng = mixing.whole_weights(weights), random.Random(7)
    for most in (1, 9, 60):
        blocks = {k: rng.randint(1, most) for k in whole}
        slots, starts = mixing.schedule(blocks, whole)
        assert (slots, starts) == earliest_deadline_first(blocks, whole)
        assert sorted(t for s in slots.values() for t in s) == list(range(sum(blocks.values()))) and {k: len(s) for k, s in slots.items()} == blocks


@pytest.mark.parametrize("weights", WEIGHTS)
def test_deviation_from_target_weights_is_under_one_block(weights):
    """20,000 slots of the first phase, against the weights as given."""
    total = sum(Fraction(str(w)) for w in weights.values())
    share = {k: Fraction(str(w)) / total for k, w in weights.items()}
    slots, starts = mixing.schedule({k: int(20_000 * w) + 3 for k, w in share.items()}, mixing.whole_weights(weights))
    end = starts[1] if len(starts) > 1 else sum(map(len, slots.values()))
    assert end >= 20_000
    for k, w in share.items():
        for c, t in enumerate(x for x in slots[k] if x < end):
            assert abs(c - w * t) < 1 and abs(c + 1 - w * (t + 1)) < 1


def test_default_weights_of_many_tiny_sources():
    counts = {"big": 10**9, **{f"tiny{i}": 1 for i in range(20)}}
    weights = mixing.tempered(counts)
    assert weights["big"] == math.isqrt(10**21) and weights["tiny3"] == 10**6
    slots, _ = mixing.schedule({"big": 700_000, **{f"tiny{i}": 1 for i in range(20)}}, weights)
    assert sum(map(len, slots.values())) == 700_020
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 1, "b": 0})


def test_mixed_rows(spark, messy, none):
    out = mixing.mixed(messy, block_rows=2).collect()
    assert len(out) == messy.count() and len({r.place for r in out}) == len(out)
    blocks, sizes = collections.defaultdict(set), collections.Counter()
    for r in out:
        blocks[r.slot].add((r.doc.source, r.block))
        sizes[r.doc.source, r.block] += 1
    assert all(len(b) == 1 for b in blocks.values()) and sorted(blocks) == list(range(len(blocks))) and max(sizes.values()) == 2
    counts = collections.Counter(r.doc.source for r in out)
    want, _ = earliest_deadline_first({k: -(-n // 2) for k, n in counts.items()}, mixing.tempered(counts))
    assert {(k, b): t for k, s in want.items() for b, t in enumerate(s)} == {(r.doc.source, r.block): r.slot for r in out}
    given = mixing.mixed(messy, {"src0": "0.9", "src1": 0.05}, block_rows=3, most_blocks=10).collect()
    assert len(given) == len(out) and max(collections.Counter((r.doc.source, r.block) for r in given).values()) == -(-len(out) // 10)
    ordered = mixing.in_mixed_order(messy)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert ordered.columns == messy.columns and sorted(ordered.collect(), key=key) == sorted(messy.collect(), key=key)
    assert mixing.mixed(none).count() == 0 and mixing.in_mixed_order(none).count() == 0


def test_rows_of_one_id_have_a_settled_order(spark):
    """Rows of equal doc_id that differ are placed alike whatever the table's partitions; nulls in any column and one source for all."""
    rows = [(1 if i % 3 else None, f"text {i}" if i % 5 else None, "s" if i % 2 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = [{(r.doc.doc_id, r.doc.text, r.doc.source, r.place) for r in mixing.mixed(docs.repartition(k, "text")).where("doc.text IS NOT NULL").collect()} for k in (1, 5)]
    assert places[0] == places[1] and len(places[0]) == 240


@pytest.mark.parametrize("rows", [1, 16, 40])
def test_mix_equals_its_sql(spark, data, rows):
    """As registered, and with other block sizes."""
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source")
    df = mixing.mixed(docs, block_rows=rows).select("doc.doc_id", "doc.source", "block", "slot", "place")
    want = c.sql(mixing.SQL.replace(f"greatest({mixing.BLOCK_ROWS},", f"greatest({rows},"))
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    full, less = shards.lookup_table(names, 1009), shards.lookup_table(names[:-1], 1009)
    sizes = collections.Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    moved = sum(names[a] != names[b] for a, b in zip(full, less) if a != 19)
    assert moved / 1009 < 0.25
    with pytest.raises(ValueError):
        shards.lookup_table(names, 1000)


def test_table_matches_turns_of_claims():
    names, size = ["x", "y", "z"], 13
    prefs = [[(shards._hash(n, "offset") % size + j * (shards._hash(n, "skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner = [-1] * size
    while -1 in owner:
        for i, p in enumerate(prefs):
            if -1 in owner:
                owner[next(s for s in p if owner[s] < 0)] = i
    assert shards.lookup_table(names, size) == owner


def test_placement(spark, messy, none, tmp_path):
    out = shards.placed(messy, shards=["a", "b", "c"]).collect()
    table = shards.lookup_table(["a", "b", "c"])
    assert len(out) == messy.count() and all(r.shard == "abc"[table[r.slot]] for r in out)
    assert shards.placed(none).count() == 0
    shards.write_shards(messy, str(tmp_path / "s"), shards=["a", "b"], files=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == messy.count()


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    odds, trans, counts = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 1, 3, 1])
    good, pairs = lines.marginals(odds, counts, trans)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts:
        z, m = 0.0, np.zeros(n)
        pr = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(o * v for o, v in zip(odds[at : at + n], y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            m += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pr[a, b] += w
        assert good[at : at + n] == pytest.approx(m / z)
        want_pairs += pr / z
        at += n
    assert pairs == pytest.approx(want_pairs)


def test_gradient_is_of_the_loss():
    rng = np.random.default_rng(0)
    x, counts, labels, weight = rng.normal(size=(12, 5)), np.array([4, 5, 3]), np.array([1, 0, 1]), rng.uniform(0.1, 1, 3)
    at = rng.normal(size=9)
    f = lambda v: lines.loss(x, counts, labels, weight, 0.1, v[:5], v[5:].reshape(2, 2))
    step = 1e-6 * np.eye(9)
    assert [(f(at + e) - f(at - e)) / 2e-6 for e in step] == pytest.approx(lines.gradient(x, counts, labels, weight, 0.1, at[:5], at[5:].reshape(2, 2)), abs=1e-6)


def test_partition_equals_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    odds, trans, counts = rng.normal(size=8), rng.normal(size=(2, 2)), np.array([1, 4, 3])
    at = 0
    for n, got in zip(counts, lines.partition(odds, counts, trans)):
        z = sum(math.exp(sum(o * v for o, v in zip(odds[at : at + n], y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=int(n)))
        assert got == pytest.approx(math.log(z))
        at += n


def plain_features(text):
    """Line by line, from the definitions."""
    out, seen = [], set()
    for line in text.split("\n"):
        raw, w = line.encode(), [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
        n, k = max(len(raw), 1), max(len(w), 1)
        share = [sum(b in v for b in raw) / n for v in lines.CLASSES.values()] + [sum(b > 127 for b in raw) / n]
        echo = sum(a == b for a, b in zip(w, w[1:]))
        out.append([*share, math.log1p(len(raw)), math.log1p(len(w)), sum(len(x.encode()) for x in w) / k / 8, echo / k, float(bool(raw) and raw[-1:] in (b".", b"!", b"?", b":", b'"', b"'")), float(bool(w) and tuple(w) in seen), float(not w)])
        seen.add(tuple(w))
    return out


def test_scores_equal_plain_ones(messy):
    """Features from the definitions, marginals by enumeration, mean weighted by length; texts of up to ten lines."""
    import itertools

    rng = np.random.default_rng(5)
    width = len(lines.OWN)
    model = lines.LineModel(rng.normal(size=width).astype(np.float32) * 0.1, np.ones(width, np.float32), rng.normal(size=3 * width + 1) * 0.4, rng.normal(size=(2, 2)))
    texts = ["", "a b\nb a\na b\n\n a b \n", "x", *(r.text for r in messy.collect() if r.text and r.text.count("\n") < 9), "Short line.\n### !!! ###\nword word word\n" * 3]
    from lumenfold.llm.shared import text_buffers

    raw, offsets = text_buffers(pa.array(texts))
    own, _, counts = lines.line_features(raw, offsets)
    assert own == pytest.approx(np.array([f for t in texts for f in plain_features(t)]), abs=1e-5) and counts.tolist() == [t.count("\n") + 1 for t in texts]
    for t, got in zip(texts, model.scores(raw, offsets)):
        f = (np.array(plain_features(t)) - model.mean) / model.scale
        near = lambda i: f[i] if 0 <= i < len(f) else np.zeros(width)
        odds = [float(np.concatenate((near(i), near(i - 1), near(i + 1), [1])) @ model.weights) for i in range(len(f))]
        z, good = 0.0, np.zeros(len(f))
        for y in itertools.product((0, 1), repeat=len(f)):
            w = math.exp(sum(o for o, v in zip(odds, y) if v) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
            z, good = z + w, good + w * np.array(y)
        size = np.maximum([len(x.encode()) for x in t.split("\n")], 1)
        assert got == pytest.approx((good / z * size).sum() / size.sum(), abs=1e-4)


def test_all_lines_teach(spark):
    """Documents that differ after their two-hundredth line only: the fit tells them apart."""
    rng = random.Random(8)
    good = lambda n: [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(9)) + "." for _ in range(n)]
    rows = [(i, "\n".join(good(210) + (good(200) if i % 2 else ["#### $$$$ %%%% !!!!"] * 200)), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    out = lines.line_quality(docs, labels).collect()
    assert max(r.score for r in out if r.doc_id % 2 == 0) < min(r.score for r in out if r.doc_id % 2)
    marks = lines.line_marginals(docs, lines.train(docs, labels)).where("doc_id < 2").collect()
    texts = dict(r[:2] for r in rows)
    assert len(marks) == 820 and all(texts[r.doc_id].encode()[r.start : r.start + r.size].decode() == texts[r.doc_id].split("\n")[r.line] for r in marks)
    junk = [r.good for r in marks if r.doc_id == 0 and r.line > 230]
    assert max(junk) < 0.5


def test_model_is_the_same_whatever_the_partitions(spark):
    """Rows of one id that differ: the longest text teaches."""
    rows = [(i, f"{'good words here.' if i % 2 else '### %%% !!!'} {i} {j}" * (j + 1)) for i in range(30) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    a, b = (lines.train(docs.repartition(k, "text"), labels) for k in (1, 7))
    assert (a.weights == b.weights).all() and (a.trans == b.trans).all()


def test_quality_on_held_out_rows(spark, data):
    out = lines.query(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


def test_quality_edge_cases(spark, messy, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (4, None, 0), (11, 0, 0), (None, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    out = lines.line_quality(messy, labels)
    assert out.count() == messy.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {r.score for r in lines.line_quality(messy, labels.where("false")).collect()} == {0.5}
    assert lines.line_quality(none, labels).count() == 0
    assert lines.only_good(messy, labels).columns == messy.columns
