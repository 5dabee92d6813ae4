"""Operators 6, 8 and 9 against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from lumenfold.llm import digest, simhash, substrings
from lumenfold.llm.shared import window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def removed(rows, window):
    lists = [WORD.findall(r.text or "") for r in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, lists):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r.doc_id is None, r.doc_id or 0, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 20, 5, 70])
def test_windows(messy, window):
    got = substrings.remove_repeats(messy.select("doc_id", "text"), window).select("doc.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == removed(messy.collect(), window)


def test_levels_double():
    assert substrings.levels(35) == [9, 18, 35]
    for w in (1, 12, 13, 50, 100, 257):
        lv = substrings.levels(w)
        assert lv[-1] == w and all(b <= 2 * a for a, b in zip(lv, lv[1:]))


def test_window_hash_is_of_its_words_only():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 50).astype(np.uint64), rng.integers(0, 2**63, 50).astype(np.uint64)
    b[10:29] = a[20:39]
    for n in (1, 2, 3, 9, 18, 19):
        ha, hb = window_hashes(a, n), window_hashes(b, n)
        assert ha[20] == hb[10] and ha[0] != hb[0]


def test_equal_hashes_of_one_family_remove_nothing(spark, monkeypatch):
    """With a first family of hashes that is the same for all words, the second one alone still tells windows apart."""
    real = substrings.word_hashes
    monkeypatch.setattr(substrings, "word_hashes", lambda raw, starts, ends, family=0: real(raw, starts, ends, family) if family else np.full(len(starts), 7, np.uint64))
    run = substrings._next_level([9, 18, 35], 2, 3)
    import pyarrow as pa

    rng = random.Random(3)
    text = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(60)) for _ in range(3)]
    text.append(text[0])
    batch = pa.RecordBatch.from_pydict({"__row": pa.array([0, 1, 2, 3], pa.int64()), "text": text, "found": pa.array([list(range(60))] * 4, pa.list_(pa.int32()))})
    met = [(r["rows"], r["pos"]) for b in substrings._meet(2)(run([batch])) for r in b.to_pylist()]
    rows = {int(x) for r, _ in met for x in np.frombuffer(r, np.int64)}
    assert rows == {0, 3}


def test_text_form_keeps_columns_and_layout(messy):
    out = substrings.without_repeats(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    for r in out.collect():
        if r.doc_id == 9:
            assert r.text == "one" and r.n_chars == 3
        if r.doc_id == 0:
            assert r.text == "" and r.n_chars == 0 and r.score == 0.5
        if r.doc_id == 13:
            assert "  double  gaps\r\n" in r.text


def test_substrings_on_empty_table(none):
    assert substrings.remove_repeats(none.select("doc_id", "text")).count() == 0


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints_and_components(messy):
    rows = messy.collect()
    got = simhash.near_duplicates(messy).collect()
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in got) == sorted((r.doc_id or -1, fingerprint(r.text)) for r in rows)
    prints = {(r.doc_id, fingerprint(r.text)) for r in rows}
    group = {x: {x} for x in prints}
    for a in prints:
        for b in prints:
            if (a[1] ^ b[1]).bit_count() <= 2 and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    for r in got:
        ids = [i for i, _ in group[r.doc_id, r.fp % 2**64] if i is not None]
        assert r.component_id == min(ids, default=None)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 8, 12])
def test_search_finds_all_links(radius):
    """Clusters, chains and noise: the forest's components are those of all links; wide buckets take the second split."""
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in range(5):
        x = rng.getrandbits(64)
        for _ in range(120):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, max(1, radius))))
    f = np.array(sorted(fps), np.uint64)
    bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    both = bits.T @ bits
    parts = simhash.plan_partitions(len(f), np.diag(both).copy(), both, radius)
    assert sum(p.threshold for p in parts) == radius - len(parts) + 1 and sorted(b for p in parts for b in p.bits) == list(range(64))
    keys, who = simhash.keys_of(f, parts)
    a, b = simhash.bucket_links(keys, f[who], radius)
    at = {int(x): i for i, x in enumerate(f)}
    got = simhash.components(len(f), np.array([at[int(x)] for x in a], int), np.array([at[int(x)] for x in b], int))
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None]) <= radius, 1))
    assert (got == simhash.components(len(f), i, j)).all()
    for spread in (simhash._spread, simhash._visit):
        s, d = spread(f, radius)
        assert (simhash.components(len(f), s, d) == simhash.components(len(f), i, j)).all()


def test_every_radius_has_a_plan():
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    both = bits.T @ bits
    for radius in (0, 5, 40, 64):
        parts = simhash.plan_partitions(500, np.diag(both).copy(), both, radius)
        assert parts and sum(p.threshold for p in parts) == radius - len(parts) + 1 and sorted(b for p in parts for b in p.bits) == list(range(64))
    with pytest.raises(ValueError):
        simhash.plan_partitions(500, np.diag(both).copy(), both, 65)


def test_connected_chain(spark):
    from lumenfold.llm.shared import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 100)], "a long, b long")
    got = {r.a: r.root for r in simhash.connected(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_one_of_each_group(messy):
    out = simhash.one_of_each_group(messy)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == messy.columns
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids  # copies, a near copy and a repeated row
    assert [i for i in ids if i in (3, 4, 5)] == [3]  # texts without words
    assert {6, 7, 8, 9, 10, 12}.issubset(ids) and None in ids


def test_simhash_on_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each_group(none).count() == 0


def scrambled(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


BYTE_VALUES = [scrambled(i * 0x9E3779B97F4A7C15 % 2**64) & 0xFFFF for i in range(1, 1 + 256 * 18)]


def plain_digest(text):
    """Byte by byte: triplets of each window of five, counted, sorted, quartered."""
    raw = text.encode()
    seen = raw + b"\0" * 4 if 0 < len(raw) < 5 else raw
    counts = [0] * 256
    for end in range(4, len(seen)):
        for k, (i, j) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
            a, b, c = (BYTE_VALUES[(k * 3 + place) * 256 + byte] for place, byte in enumerate((seen[end], seen[end - i], seen[end - j])))
            h = ((a ^ b) + c) % 65536
            counts[(h ^ h >> 7) & 255] += 1
    ranked = sorted(counts)
    q = [ranked[63], ranked[127], ranked[191]]
    codes = [sum(c > x for x in q) for c in counts]
    length = int(math.log(max(len(raw), 1)) / math.log(1.2)) % 256
    ratios = [q[0] * 100 // q[2] % 16, q[1] * 100 // q[2] % 16] if q[2] else [0, 0]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}" + "".join(f"{codes[i] * 64 + codes[i + 1] * 16 + codes[i + 2] * 4 + codes[i + 3]:02x}" for i in range(0, 256, 4))


def plain_likeness(a, b):
    """The difference, part by part, over 400."""
    around = lambda x, y, n: min(abs(x - y), n - abs(x - y))
    length = around(int(a[:2], 16), int(b[:2], 16), 256)
    total = length if length <= 1 else min(12 * length, 96)
    for x, y in zip(a[2:4], b[2:4]):
        d = around(int(x, 16), int(y, 16), 16)
        total += d if d <= 1 else min(d - 1, 4)
    bits = lambda d: [int(x, 16) >> s & 3 for x in d[4:] for s in (2, 0)]
    total += sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(bits(a), bits(b)))
    return 1 - min(total, 400) / 400


def test_digests(messy):
    """All rows in order; of the repeated row, the first copy's next is the second."""
    order = sorted(messy.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = []
    for i, r in enumerate(order):
        t, n = r.text or "", order[(i + 1) % len(order)].text or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = (plain_digest(x) for x in (t, e, n))
        want.append((r.doc_id is None, r.doc_id or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in digest.fingerprints(messy).collect()]
    assert sorted(got) == sorted(want)


def test_digests_of_short_texts_differ():
    texts = ["", "a", "b", "ab", "abcd", "wxyz", "abce", "abcde", "é", "\0"]
    prints = [digest.digest(digest._raw(t)) for t in texts]
    assert len(set(prints)) == len(texts) and digest.likeness(prints[4], prints[5]) < 1


def test_digest_scores_are_bounded():
    rng = random.Random(2)
    texts = ["", "abc", "a" * 1000, *("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (10, 500, 5000))]
    prints = [digest.digest(digest._raw(t)) for t in texts]
    for a in prints:
        for b in prints:
            assert 0 <= digest.likeness(a, b) <= 1 and digest.likeness(a, b) == digest.likeness(b, a)
        assert digest.likeness(a, a) == 1


def test_digest_of_one_and_no_document(spark, none):
    one = digest.fingerprints(spark.createDataFrame([(7, "only one here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert digest.fingerprints(none).count() == 0


def test_dotted_column_names(spark):
    from lumenfold.llm import mixing, shards

    docs = spark.createDataFrame([(1, "a b", "s", 2), (2, "c", "s", 3)], "doc_id long, text string, source string, `odd.name` int")
    for out in (substrings.without_repeats(docs), simhash.one_of_each_group(docs), mixing.in_mixed_order(docs), shards.placed(docs).select("doc.*")):
        assert out.columns == docs.columns and out.count() == 2
