"""The pipeline's stages on a small fixture, and the registration of all ten operators."""

import collections

import pytest


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_ten_operators_are_registered(entry):
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, data, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    good, near, cut, mixed = (seen[n] for n in ("quality classifier", "simhash near-dedup", "substring dedup", "mixing sources"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    judged = [labels[i] == (i in kept) for i in labels]
    assert sum(judged) / len(judged) > 0.95
    texts = collections.Counter(r.text for r in near.collect())
    assert max(texts.values()) == 1 and {r.text for r in good.collect()} >= set(texts)
    assert {r.doc_id for r in cut.collect()} == {r.doc_id for r in near.collect()} == {r.doc_id for r in mixed.collect()}
    assert sum(r.n_chars for r in cut.collect()) < sum(r.n_chars for r in near.collect())
    packed = seen["packing"].groupBy("doc_id").sum("length").count()
    assert packed == mixed.count()


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run_equals_brute_force(spark, tmp_path):
    """Near copies by exact similarities of all pairs, repeats by a count of all windows, packing by the library's ids, on whole small tables."""
    import hashlib
    import zlib

    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from lumenfold.llm import mixing, packing, substrings

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    stays = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    like = {(a, b): len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) if sets[a] or sets[b] else 1.0 for a in sets for b in sets if a < b}
    for (a, b), j in like.items():
        assert j < 0.8 or not (a in stays and b in stays)
    for d in sets.keys() - stays:  # each has a partner, up to the estimate's error
        assert max(j for pair, j in like.items() if d in pair) > 2 / 3 - 0.16
    # a group that exact similarity holds together far above or below the bound
    group = {d: {d} for d in sets}
    for (a, b), j in like.items():
        if j >= 0.55 and group[a] is not group[b]:
            group[a] |= group[b]
            for d in group[b]:
                group[d] = group[a]
    assert all(min(g) in stays for g in group.values())
    near = docs.where(docs.doc_id.isin(list(stays)))
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_substrings(spark, near, "").collect()}
    from .test_text_dedup import WORD, removed

    want = {d: (n, gone, kept) for _, d, n, gone, kept in removed(near.collect(), substrings.WINDOW)}
    for d, r in cut.items():
        assert len(WORD.findall(r.text)) == want[d][0] - want[d][1] and r.n_chars == len(r.text)
        assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == want[d][2]
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(list(cut.values()), docs.schema), "")
    assert sorted(mixed.collect()) == sorted(cut.values())
    places = mixing.mixed(spark.createDataFrame(list(cut.values()), docs.schema))
    order = [r.doc.doc_id for r in sorted(places.collect(), key=lambda r: r.place)]
    assert [r.doc_id for part in mixed.rdd.glom().collect() for r in part] == order
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    pieces = collections.defaultdict(list)
    for p in corpus_pipeline.pack(spark, mixed, "").collect():
        pieces[p.doc_id].append(p)
    assert pieces.keys() == cut.keys()
    for d, parts in pieces.items():
        ids = np.array([*lib.encode(cut[d].text, add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize("table", ["messy", "none"])
def test_stages_on_odd_tables(spark, data, tmp_path, request, table):
    """Nulls in every column, empty texts, a repeated row, clashing columns; and no rows at all."""
    import corpus_pipeline

    docs = request.getfixturevalue(table)
    columns, start = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, data).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
        if name in ("substring dedup", "mixing sources"):
            assert docs.count() == before.count()
    assert docs.agg({"length": "sum"}).first()[0] == (None if not start else sum(r.doc_tokens for r in docs.where("start = 0").collect()))


def test_near_stage_catches_planted_copies(spark):
    """Copies with one word in forty changed go, unrelated texts and the group's first stay."""
    import random

    from lumenfold.llm import simhash

    rng = random.Random(9)

    def word():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))

    rows, near = [], []
    for g in range(30):
        text = [word() for _ in range(200)]
        rows.append((g * 10, " ".join(text)))
        for c in range(1, 4):
            copy = [word() if rng.random() < 1 / 40 else w for w in text]
            rows.append((g * 10 + c, " ".join(copy)))
            near.append(g * 10 + c)
    left = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g * 10 for g in range(30)} <= left
    assert len(left & set(near)) <= 0.1 * len(near)
