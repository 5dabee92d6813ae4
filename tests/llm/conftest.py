import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, component_id long, kept string, doc string, row int, slot long, place long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows_of():
    """Nulls in every column, empty and white texts, one long text, copies, near copies, a shared passage, a repeated row."""
    rng = random.Random(5)
    passage = words(rng, 60)
    base = words(rng, 120)
    near = base.split(" ")
    near[50] = "changed"
    texts = {0: base, 1: base, 2: " ".join(near), 3: None, 4: "", 5: " \n\t ", 6: words(rng, 30) + "\n" + passage, 7: passage + " " + words(rng, 25), 8: words(rng, 5000), 9: "one", 10: "Two words", 11: "x " * 200, 12: "Ünï çödé — “quoted” … text, with marks!", 13: words(rng, 40) + "  double  gaps\r\n" + words(rng, 40)}
    out = [(k, t, "en", f"src{k % 3}", None if t is None else len(t), 0.5, 1, 2, "a", "b", k, 3, 4) for k, t in texts.items()]
    out += [(20 + k, words(rng, rng.randint(1, 80)), "en" if k % 2 else None, "src0" if k % 3 else None, 7, None, None, None, None, None, None, None, None) for k in range(40)]
    out += [out[0], (None, "a row without id " + words(rng, 30), None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame(rows_of(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
