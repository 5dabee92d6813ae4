"""Properties on generated inputs, against plain Python."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.functions import kernels
from lumenfold.operators import build, trees

WORDS = st.lists(st.sampled_from("abcde"), max_size=12)


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_common_length_equals_the_table_method(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert kernels.common_length(a, b) == rows[-1][-1]


@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from("ct")), max_size=12))
@settings(max_examples=200, deadline=None)
def test_nearest_pairs_are_one_to_one(items):
    captions = [(p, f"c{i}") for i, (p, k) in enumerate(items) if k == "c"]
    targets = [(p, f"t{i}") for i, (p, k) in enumerate(items) if k == "t"]
    got = build.nearest_pairs(captions, targets)
    assert len(got) == min(len(captions), len(targets)) and len({c for c, _ in got}) == len({t for _, t in got}) == len(got)


@given(st.integers(1, 8), st.data())
@settings(max_examples=100, deadline=None)
def test_page_rank_is_a_distribution(n, data):
    pairs = data.draw(st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=12))
    both = sorted({(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b})
    a, b = (np.array([x[i] for x in both], int) for i in (0, 1))
    x = trees.page_rank(np.array(data.draw(st.lists(st.floats(0, 5), min_size=n, max_size=n))), a, b)
    assert abs(x.sum() - 1) < 1e-9 and (x >= 0).all()


@given(st.integers(2, 6), st.data())
@settings(max_examples=100, deadline=None)
def test_prize_tree_is_connected_and_worth_it(n, data):
    names = [f"n{i}" for i in range(n)]
    pairs = {(names[i], names[j]): data.draw(st.floats(0.05, 3)) for i in range(n) for j in range(i + 1, n) if data.draw(st.booleans())}
    prizes = {x: data.draw(st.floats(0, 4)) for x in names}
    kept = trees.prize_tree(names, prizes, pairs)
    seen, todo = set(), [min(kept)]
    while todo:
        x = todo.pop()
        seen.add(x)
        todo += [b if a == x else a for a, b in pairs if x in (a, b) and {a, b} <= kept and (b if a == x else a) not in seen]
    assert kept and seen == kept


@given(st.lists(st.tuples(st.sets(st.sampled_from("abcdef"), min_size=1), st.floats(0, 5)), max_size=6), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_forest_is_within_budget(rows, budget):
    costs = {c: 3 + i for i, c in enumerate("abcdef")}
    items = [{"nodes": sorted(s), "relevance": r, "slots": ["answer"], "entities": sorted(s)[:1]} for s, r in rows]
    picked = trees.greedy_forest(items, budget, costs, 2)
    assert len(set(picked)) == len(picked) and sum(costs[n] for n in {n for i in picked for n in items[i]["nodes"]}) <= budget


@given(st.text(alphabet="aB 1é表_.ß", max_size=30))
@settings(max_examples=60, deadline=None)
def test_normalised_evidence_words(t):
    assert Counter(kernels.nfkc_words(t).split()) == Counter(re.findall(r"\w+", t.casefold()))
