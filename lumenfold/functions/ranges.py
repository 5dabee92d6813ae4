"""Placing values among sorted bounds, in a number of comparisons that grows with the logarithm of theirs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leaves of the decision tree; further bounds are looked through within a leaf.
LEAVES = 256


def range_place(x: Column, bounds: list) -> Column:
    """How many of the sorted, distinct bounds are less than x; none for a null."""
    if not bounds:
        return F.lit(0)
    width = -(-len(bounds) // LEAVES)
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def tree(lo: int, hi: int) -> Column:
        """The first group in lo..hi whose last bound is not less than x; hi if there is none."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > F.lit(groups[mid][-1]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    group = tree(0, len(groups))
    if width == 1:
        return F.when(x.isNull(), 0).otherwise(group)
    inner = F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), group)
    before = F.least(group * width, F.lit(len(bounds)))
    return F.when(x.isNull(), 0).otherwise(before + F.coalesce(F.size(F.filter(inner, lambda b: b < x)), F.lit(0)))
