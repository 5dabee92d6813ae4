"""The pipeline's near-dedup stage: contiguous edits are found, what only looks alike stays."""

import random

import pytest

from lumenfold.llm import simhash


def made(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def left(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("kind", ["appended", "tail", "middle", "scattered"])
def test_copies_of_similarity_0_8_go(spark, kind):
    """All pairs have a similarity of 0.80 to 0.83 on five-word shingles."""
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        text = made(rng, 300)
        copy = list(text)
        if kind == "appended":
            copy += made(rng, 74)
        elif kind == "tail":
            copy[-32:] = made(rng, 32)
        elif kind == "middle":
            copy[100:128] = made(rng, 28)
        else:
            for p in rng.sample(range(300), 6):
                copy[p] = made(rng, 1)[0]
        texts += [text, copy]
    kept = left(spark, texts)
    assert {i for i in range(300) if i % 2 == 0} <= kept
    assert len(kept) <= 152


def test_texts_that_only_share_long_words_stay(spark):
    """Another order, other short words, one long word in common, half of a text in common: none is a near copy."""
    rng = random.Random(4)
    text = made(rng, 200)
    shuffled = rng.sample(text, len(text))
    short = [["".join(rng.choice("abc") for _ in range(4)) for _ in range(60)] for _ in range(2)]
    half = text[:100] + made(rng, 100)
    assert left(spark, [text, shuffled, ["incomprehensible", *short[0]], ["incomprehensible", *short[1]], half]) == {0, 1, 2, 3, 4}
