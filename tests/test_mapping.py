"""Fuzzy evidence mapping: bounds leave few pairs to compare, and the result is that of comparing all."""

import random
from difflib import SequenceMatcher

import pyarrow as pa

from lumenfold.functions import kernels
from lumenfold.operators import mapping


def made_texts(n, seed, words=60):
    r = random.Random(seed)
    known = ["".join(r.choices("aeinorst", k=r.randint(1, 8))) for _ in range(words)]
    return [" ".join(r.choices(known, k=r.randint(1, 25))) for _ in range(n)]


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_blocks_and_ratios_are_those_of_difflib():
    texts = [*made_texts(60, 1), "a", "é中", "中" * 5, "x" * 700]
    for a, b in zip(texts, [*texts[1:], "y"], strict=True):
        block = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        assert kernels.longest_block(a, b) == tuple(block) or block.size == 0
        for floor in (0.0, ratio(a, b)):
            assert kernels.reached_ratio(a, b, floor) == ratio(a, b)
        assert kernels.reached_ratio(a, b, ratio(a, b) + 1e-9) is None
        assert kernels.common_lengths(a, texts).tolist() == [kernels.common_length(a, t) for t in texts]


def test_bounds_leave_few_pairs(monkeypatch):
    """Letters alone, the bound before, leave over four times as many."""
    compared = []
    whole = kernels.reached_ratio
    monkeypatch.setattr(kernels, "reached_ratio", lambda *x: compared.append(x) or whole(*x))
    texts, asked = made_texts(2000, 2), made_texts(1, 3)[0]
    table = pa.table({"evidence_id": [7] * 2000, "q": [asked] * 2000, "floor": [0.5] * 2000, "o": range(2000), "node_id": [f"n{i}" for i in range(2000)], "t": texts})
    got = [r for b in kernels.best_ratios(table.to_batches(500)) for r in b.to_pylist()]
    best = max(ratio(asked, t) for t in texts)
    first = next(i for i, t in enumerate(texts) if ratio(asked, t) == best)
    letters = sum(SequenceMatcher(None, asked, t).quick_ratio() >= best for t in texts)
    assert got == [{"evidence_id": 7, "score": best, "o": first, "node_id": f"n{first}"}]
    assert len(compared) < 200 and letters > 4 * len(compared)


def test_equals_the_comparison_of_all_pairs(spark):
    texts = [*made_texts(300, 4), *made_texts(50, 4)]  # some twice: the first is meant
    nodes = [(f"n{i}", f"p{i % 2}", "Sentence", t, i // 3) for i, t in enumerate(texts)]
    asked = [(i, f"p{i % 3}", t) for i, t in enumerate([*made_texts(8, 5), texts[5][1:-1] + " end"])]
    e = spark.createDataFrame(asked, "evidence_id int, paper_id string, evidence string")
    got = {r.evidence_id: (r.node_id, r.score) for r in mapping.map_evidence(e, spark.createDataFrame(nodes, "node_id string, paper_id string, node_type string, text string, ord int"), 0.4).collect()}
    want = {}
    for i, paper, q in asked:
        scores = []
        for node, own, _, t, o in nodes:
            a, b = set(q.split()), set(t.split())
            if own == paper:
                scores.append((-max(ratio(q, t), len(a & b) / len(a | b)), o, node))
        s = min(scores, default=(0.0, 0, None))
        want[i] = (s[2] if -s[0] >= 0.4 else None, -s[0])
    assert got == want
