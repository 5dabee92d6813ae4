"""Kernels on one small graph each: personalised PageRank, prize-collecting Steiner trees, and the greedy evidence forest.

They run inside grouped Arrow batches; a group is one query's hits (or one paper's part of them), bounded by the recall depth.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Cost of an edge by relation.
RELATION_COSTS = {
    "caption_of": 0.10,
    "refers_to": 0.20,
    "derived_from": 0.10,
    "next_sentence": 0.50,
    "contains": 0.30,
    "semantically_similar": 1.20,
}


def page_rank(scores: np.ndarray, a: np.ndarray, b: np.ndarray, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """Ranks of nodes with the given teleport scores over distinct directed pairs (a, b)."""
    n = len(scores)
    if not n:
        return scores
    prize = np.maximum(scores, 0.0)
    p = prize / prize.sum() if prize.sum() > 0 else np.full(n, 1.0 / n)
    degree = np.bincount(a, minlength=n).astype(float)
    x = p.copy()
    for _ in range(rounds):
        flow = np.bincount(b, weights=x[a] / degree[a], minlength=n) if len(a) else np.zeros(n)
        nxt = (1 - damping + damping * x[degree == 0].sum()) * p + damping * flow
        moved = np.abs(nxt - x).sum()
        x = nxt
        if moved < tolerance:
            break
    return x


def cheapest_pairs(edges: Iterable[tuple[str, str, str]], scale: float = 1.0, costs: dict[str, float] | None = None) -> dict[tuple[str, str], float]:
    """Undirected pairs with their least cost; loops go, an unknown relation costs 1."""
    table, out = costs or RELATION_COSTS, {}
    for src, dst, relation in edges:
        if src != dst:
            pair, c = (min(src, dst), max(src, dst)), table.get(relation, 1.0) * scale
            out[pair] = min(c, out.get(pair, c))
    return out


def positive_prizes(prizes: dict[str, float]) -> set[str]:
    """What stands in for a tree without a solver: nodes of positive prize, else the one of greatest prize."""
    positive = {n for n, p in prizes.items() if p > 0}
    return positive or ({max(sorted(prizes), key=prizes.get)} if prizes else set())


class _Growth:
    """Moats of the primal-dual scheme: clusters grow evenly until edges tighten or prizes are spent."""

    def __init__(self, names: list[str], prizes: dict[str, float], pairs: dict[tuple[str, str], float]):
        self.names, self.at = names, {n: i for i, n in enumerate(names)}
        n = len(names)
        self.members = [{i} for i in range(n)]
        self.root = list(range(n))  # cluster of each node
        self.left = [max(prizes.get(x, 0.0), 0.0) for x in names]  # prize not yet spent
        self.active = [p > 0 for p in self.left]
        self.moat = [0.0] * n  # dual spent on a node's clusters so far
        self.pairs = [(self.at[a], self.at[b], c) for (a, b), c in sorted(pairs.items())]
        self.forest: list[tuple[int, int]] = []
        self.idle: list[frozenset[int]] = []  # clusters that spent their prize, in that order

    def run(self) -> None:
        while sum(self.active) > 1:
            step, what = min(((self.left[c], (1, c, 0)) for c in range(len(self.active)) if self.active[c]), key=lambda x: (x[0], x[1]))
            for k, (a, b, cost) in enumerate(self.pairs):
                ca, cb = self.root[a], self.root[b]
                speed = self.active[ca] + self.active[cb]
                if ca != cb and speed:
                    t = max(cost - self.moat[a] - self.moat[b], 0.0) / speed
                    if t < step - 1e-15 or (abs(t - step) <= 1e-15 and what[0] == 1):
                        step, what = t, (0, k, 0)
            for c, on in enumerate(self.active):
                if on:
                    self.left[c] -= step
                    for i in self.members[c]:
                        self.moat[i] += step
            if what[0]:
                c = what[1]
                self.active[c], self.left[c] = False, 0.0
                self.idle.append(frozenset(self.members[c]))
            else:
                a, b, _ = self.pairs[what[1]]
                self._merge(a, b)

    def _merge(self, a: int, b: int) -> None:
        ca, cb = self.root[a], self.root[b]
        self.forest.append((a, b))
        for i in self.members[cb]:
            self.root[i] = ca
        self.members[ca] = self.members[ca] | self.members[cb]
        self.members[cb] = set()
        self.left[ca] += self.left[cb]
        self.active[ca], self.active[cb] = self.left[ca] > 1e-15, False
        if not self.active[ca]:
            self.idle.append(frozenset(self.members[ca]))

    def pruned(self) -> set[int]:
        """The last active cluster's tree without the spent clusters that hang from it by a single edge."""
        last = [c for c, on in enumerate(self.active) if on]
        if not last:
            return set()
        tree = set(self.members[last[0]])
        edges = [(a, b) for a, b in self.forest if a in tree and b in tree]
        changed = True
        while changed:
            changed = False
            for spent in self.idle:
                inside = spent & tree
                if not inside or inside == tree:
                    continue
                if sum((a in inside) != (b in inside) for a, b in edges) == 1:
                    tree -= inside
                    edges = [(a, b) for a, b in edges if a in tree and b in tree]
                    changed = True
        return tree


def prize_tree(nodes: Iterable[str], prizes: dict[str, float], pairs: dict[tuple[str, str], float]) -> set[str]:
    """An unrooted prize-collecting Steiner tree by Goemans and Williamson's growth and pruning; one tree.

    Growth ends when one cluster is active. If the prizes leave none, the best single node is the tree.
    """
    names = sorted(nodes)
    if not names:
        return set()
    growth = _Growth(names, prizes, pairs)
    growth.run()
    kept = growth.pruned()
    return {names[i] for i in kept} if kept else {max(names, key=lambda x: (max(prizes.get(x, 0.0), 0.0), x))}


def _incidence(sets: list, names: list) -> np.ndarray:
    """Which of the names each set holds."""
    at = {x: i for i, x in enumerate(names)}
    out = np.zeros((len(sets), len(names)))
    for k, members in enumerate(sets):
        out[k, [at[x] for x in members]] = 1
    return out


def greedy_forest(trees: list[dict], budget: int, costs: dict[str, int], required: int, slot_weight: float = 0.4, entity_weight: float = 0.3, redundancy: float = 0.2) -> list[int]:
    """Indexes of trees (nodes, relevance, slots, entities), picked by gain over marginal cost until nothing fits or gains.

    All trees' marginal costs and gains come from three incidence matrices and what is covered so far; the first of equals is picked.
    """
    if not trees:
        return []
    names, parts = {}, {}
    for field in ("nodes", "slots", "entities"):
        names[field] = sorted({x for t in trees for x in t[field]})
        parts[field] = _incidence([set(t[field]) for t in trees], names[field])
    price, size = np.array([costs[n] for n in names["nodes"]], float), parts["nodes"].sum(1)
    fresh = {field: np.ones(len(x)) for field, x in names.items()}
    relevance, picked, spent = np.array([t["relevance"] for t in trees], float), [], 0.0
    while True:
        marginal = parts["nodes"] @ (price * fresh["nodes"])
        shared = 1 - (parts["nodes"] @ fresh["nodes"]) / np.maximum(size, 1)
        gain = relevance + slot_weight * (parts["slots"] @ fresh["slots"]) / max(required, 1) + entity_weight * (parts["entities"] @ fresh["entities"]) - redundancy * shared
        fits = (marginal > 0) & (spent + marginal <= budget) & (gain > 0)
        if not fits.any():
            return picked
        best = int(np.argmax(np.where(fits, gain / np.where(fits, marginal, 1), -1)))
        picked.append(best)
        spent += marginal[best]
        for field, x in parts.items():
            fresh[field] = np.where(x[best] > 0, 0, fresh[field])
