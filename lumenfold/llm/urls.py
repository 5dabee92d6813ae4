"""URL filters: longest-match rules, and gradient-boosted trees on lexical features for the rest (operator 10).

Features, fitting data, binning and scoring are native expressions. The trees are grown on the driver from a bounded
sample of labelled rows (FIT_ROWS feature rows, smallest hashes first) and become one CASE expression. One half of the labelled urls, by
hash, gives the suffix statistics and the other half teaches the trees, so that no row's own label is in its features.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Fixed values: (verdict, host and path prefix).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
FIT_ROWS = 20_000
#: Suffix rates are broadcast up to so many rows (their number is counted first); more are joined by salted suffixes.
BROADCAST_ROWS, SALTS = 100_000, 16
FEATURES = ("n_chars", "host_chars", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "n_host_digits", "path_chars", "suffix_rate")


def url_parts(url) -> tuple[Column, Column]:
    """(host, path): host from the first :// up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as one CASE (for tables of up to some hundred rules)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, prefix = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As rule_column, for rule tables (verdict, rule) of any size: every host suffix and path folder probes the rules by equality.

    urls needs __row, host and path; returns __row and rule. Rules must end in '/'.
    """
    labels = urls.select("__row", F.split("host", r"\.").alias("l"), F.split("path", "/").alias("p"))
    tails = labels.select("__row", "p", F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", i, F.size("l")), "."))).alias("at"))
    folders = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat(F.array_join(F.slice("p", 1, i), "/"), F.lit("/")))
    keys = tails.where(F.size("p") > 1).select("__row", "at", F.explode(folders).alias("folder")).select("__row", F.concat("at", "folder").alias("rule"))
    hit = keys.join(rules.select("rule").distinct(), "rule")
    return hit.groupBy("__row").agg(F.max_by("rule", F.struct(F.length("rule"), "rule")).alias("rule"))


def _features(u: DataFrame) -> DataFrame:
    chars = F.split("url", "")
    n = F.length("url")
    counted = u.withColumn("__c", F.array_distinct(chars)).withColumn(
        "__c", F.transform("__c", lambda c: (n - F.length(F.replace(F.col("url"), c, F.lit("")))).cast("double") / F.greatest(n, F.lit(1)))
    )
    drop = lambda c, s: F.length(c) - F.length(F.translate(c, s, ""))
    return counted.select(
        *[c for c in u.columns],
        n.cast("double").alias("n_chars"),
        F.length("host").cast("double").alias("host_chars"),
        drop("path", "/").cast("double").alias("depth"),
        (drop("url", "0123456789") / F.greatest(n, F.lit(1))).alias("digit_ratio"),
        F.aggregate("__c", F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(F.when(p > 0, p).otherwise(1.0))).otherwise(0.0)).alias("entropy"),
        (F.when(F.col("url").contains("?"), 1).otherwise(0) + drop("url", "&")).cast("double").alias("n_params"),
        (drop("host", ".") + 1).cast("double").alias("n_labels"),
        drop("host", "-").cast("double").alias("n_hyphens"),
        drop("host", "0123456789").cast("double").alias("n_host_digits"),
        F.length("path").cast("double").alias("path_chars"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
    )


@dataclass
class Trees:
    """A sum of small trees: a node is (feature, threshold, left, right), a leaf a float."""

    base: float
    trees: list = field(default_factory=list)

    def column(self) -> Column:
        def of(t):
            return F.lit(float(t)) if isinstance(t, float) else F.when(F.col(t[0]) <= t[1], of(t[2])).otherwise(of(t[3]))

        return reduce(lambda a, t: a + of(t), self.trees, F.lit(self.base))

    def score(self, row: dict) -> float:
        total = self.base
        for t in self.trees:
            while not isinstance(t, float):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        return total


def fit_trees(rows: list[dict], labels: list[int], rounds: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 24, least: int = 5) -> Trees:
    """Second-order boosting of log loss over quantile bins; deterministic. One class or no rows give a constant."""
    n, ones = len(rows), sum(labels)
    base = math.log((ones + 1) / (n - ones + 1))
    if not n or ones in (0, n):
        return Trees(base)
    edges, binned = {}, {}
    for f in FEATURES:
        values = sorted({r[f] for r in rows})
        cut = values[:-1] if len(values) <= bins else sorted({values[len(values) * k // bins] for k in range(1, bins)})
        edges[f] = cut
        binned[f] = [bisect_left(cut, r[f]) for r in rows]
    margin, out = [base] * n, Trees(base)

    def grow(at: list[int], g, h, left: int):
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        leaf = -rate * sg / (sh + 1.0)
        best = (1e-6, None, 0)
        if left and len(at) >= 2 * least:
            for f in FEATURES:
                size = len(edges[f]) + 1
                bg, bh, bn, b = [0.0] * size, [0.0] * size, [0] * size, binned[f]
                for i in at:
                    bg[b[i]] += g[i]
                    bh[b[i]] += h[i]
                    bn[b[i]] += 1
                cg = ch = cn = 0
                for k in range(size - 1):
                    cg, ch, cn = cg + bg[k], ch + bh[k], cn + bn[k]
                    if least <= cn <= len(at) - least:
                        gain = cg * cg / (ch + 1) + (sg - cg) ** 2 / (sh - ch + 1) - sg * sg / (sh + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, k)
        if best[1] is None:
            for i in at:
                margin[i] += leaf
            return leaf
        f, k = best[1:]
        b = binned[f]
        return (f, edges[f][k], grow([i for i in at if b[i] <= k], g, h, left - 1), grow([i for i in at if b[i] > k], g, h, left - 1))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [a - y for a, y in zip(p, labels, strict=True)]
        h = [max(a * (1 - a), 1e-6) for a in p]
        out.trees.append(grow(list(range(n)), g, h, depth))
    return out


def with_rates(rows: DataFrame, rates: DataFrame, n_rates: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows (suffix, ...) with the columns of rates (__suffix, ...), null where there is none; a suffix that most rows have is spread over salts."""
    if n_rates <= most:
        return rows.join(F.broadcast(rates), F.col("suffix") == F.col("__suffix"), "left").drop("__suffix")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)))
    each = rates.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, (F.col("suffix") == F.col("__suffix")) & (F.col("__salt") == F.col("__s")), "left").drop("__suffix", "__s", "__salt")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path and rule of every row. rules: pairs (verdict, rule), or a DataFrame (verdict, rule) of any size whose rules end in '/'."""
    host, path = url_parts(F.col("url"))
    u = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        return u.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    keyed = u.withColumn("__row", F.struct("host", "path"))
    found = rule_join(keyed.select("__row", "host", "path").distinct(), rules)
    return keyed.join(found, "__row", "left").select("page_id", "url", "host", "path", "rule")


def url_filter(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS, taught_by=None) -> DataFrame:
    """One row per row of pages (page_id, url; other columns are ignored): page_id, host, path, rule, verdict, score.

    A url that a rule fits is labelled with the rule's verdict; these labels train the trees (only where the column taught_by of url holds, if given),
    which judge the rest (block if the score, the probability of block, is at least 0.5). A null url or one without :// has an empty host and
    path and no rule, and is judged by the trees. Repeated rows are judged alike; a very long url is one string. Without any labelled url the
    score is 0.5 and the verdict allow. A table without rows gives none. Suffix statistics (share of blocked urls by last host label, smoothed; 0.5 for a
    suffix without labels) count all rows of their half of the labelled ones.
    """
    u = judged(pages, rules)
    if isinstance(rules, DataFrame):
        u = u.join(rules.select("rule", F.col("verdict").alias("known")).dropDuplicates(["rule"]), "rule", "left")
    else:
        known = F.lit(None).cast("string")
        for r, v in {r: v for v, r in rules}.items():
            known = F.when(F.col("rule") == r, v).otherwise(known)
        u = u.withColumn("known", known)
    wide = _features(u)
    labelled = wide.where(F.col("known").isNotNull())
    if taught_by is not None:
        labelled = labelled.where(taught_by)
    half = F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)) == 0
    counts = labelled.where(half).groupBy("suffix").agg(F.count("*").alias("n"), F.count_if(F.col("known") == "block").alias("b"))
    totals = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("suffixes")).first()
    prior = ((totals["b"] or 0) + 1) / ((totals["n"] or 0) + 2)
    rates = counts.select(F.col("suffix").alias("__suffix"), ((F.col("b") + 10 * prior) / (F.col("n") + 10)).alias("rate"))
    rated = lambda df: with_rates(df, rates, totals["suffixes"]).withColumn("suffix_rate", F.coalesce("rate", F.lit(0.5)))
    order = (F.xxhash64("url"), F.col("url"), F.col("page_id"))
    sample = rated(labelled.where(~half).orderBy(*order).limit(fit_rows)).orderBy(*order).select("known", *FEATURES).collect()
    model = fit_trees([r.asDict() for r in sample], [int(r["known"] == "block") for r in sample])
    scored = rated(wide).withColumn("margin", model.column())
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("known", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-F.col("margin")))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")
