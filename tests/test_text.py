"""Scalar functions against literal expectations."""

import uuid

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import kernels, models
from lumenfold.functions import text as T


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, ["Réel straße 表1 x²", "", "a_b-C9"], T.tokens) == [["r", "é", "el", "stra", "ss", "e", "表", "1", "x", "²"], [], ["a_b", "c9"]]


def test_costs(spark):
    assert values(spark, ["alloy strength 500 MPa", "", None, "é表 a"], T.token_cost) == [4, 1, 1, 3]
    rows = spark.createDataFrame([("Figure", None, "f.png"), ("Table", "a b", "t.png"), ("Table", "a b", None), ("Caption", "Figure 1. strength", None)], "k string, t string, p string")
    got = [r.c for r in rows.select(T.node_cost(F.col("k"), F.col("t"), F.col("p"), 20).alias("c")).collect()]
    assert got == [20, 22, 2, 3]


def test_sentences(spark):
    rows = ["As shown in Fig. 1, the strength is improved. It grows.  Ok. Next one is here.", "Short. Tiny. A longer sentence follows", "", None, "see e.g. Smith et al. Then more text. 表示 works。好的 yes"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").withColumn("p", T.sentence_parts(F.col("t")))
    got = [r.s for r in df.select("i", T.folded_sentences(F.col("p")).alias("s")).orderBy("i").collect()]
    assert got[0] == ["As shown in Fig. 1, the strength is improved.", "It grows. Ok.", "Next one is here."]
    assert got[1] == ["Short. Tiny.", "A longer sentence follows"] and got[2] == got[3] == []
    assert got[4][0] == "see e.g. Smith et al. Then more text."


def test_labels(spark):
    assert values(spark, ["Fig. 1 and Figure 2b", "Figs. 3", "FIG 1, fig.1"], T.figure_labels) == [["1", "2b"], [], ["1"]]
    assert values(spark, ["Table 2, Tab. 3a", "表1", "tables 4"], T.table_labels) == [["2", "3a"], ["1"], []]


def test_names_and_hashes(spark):
    assert values(spark, ["http://x"], T.uuid5_of) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "http://x"))]
    assert values(spark, ["a"], lambda c: T.grouped_split(c)) == ["train"]
    assert values(spark, ["a b/c"], T.safe_name)[0].startswith("a_b_c-")
    assert values(spark, ["1,000", "5%", "x", ""], T.numeric) == [1000.0, 5.0, None, None]
    assert values(spark, ["```csv\na,b\n```", "csv\na"], T.fences_stripped) == ["a,b", "a"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r.u) for r in df.select(T.l2_normalized(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(T.dot(F.col("v"), F.col("v")).alias("d")).first().d == 25.0


def test_kernels():
    assert kernels.nfkc_words("ＤFlash:  Fast!\n") == "dflash fast"
    assert kernels.common_length("a b c".split(), "a x c".split()) == 2
    assert kernels.common_length(list("abcbdab"), list("bdcaba")) == 4 and kernels.common_length([], ["a"]) == 0
    assert kernels.html_rows("<table><tr><td>Model</td><td>F1</td></tr><tr><td>Ours</td><td> 91.2 </td><td></td></tr></table>") == "Model\tF1\nOurs\t91.2"
    assert kernels.table_cells('a,"b,c"\n--,--\n1,2') == [["a", "b,c"], ["1", "2"]]
    assert kernels.table_cells('| a | b |\n|:--|--:|\n\n| 1 ||\n') == [["a", "b"], ["1"]]
    assert kernels.table_cells('x\t"say ""so"""\n| 1|2\t3') == [["x", 'say "so"'], ["1|2", "3"]]
    assert kernels.table_cells('a,,c\n"",2,') == [["a", "", "c"], ["", "2", ""]] and kernels.table_cells(None) == kernels.table_cells(" \n--\n") == []
    assert kernels.sequence_ratio_of("abcd", "bcde") == pytest.approx(0.75)


def test_models(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    one = [list(r.v) for r in df.select(models.mock_embedding(F.col("t"), 8).alias("v")).collect()]
    assert one[0] == models.mock_vector("a", 8) != one[1] and sum(x * x for x in one[0]) == pytest.approx(1)
    got = models.with_model(df, "t", lambda xs: [float(len(x)) for x in xs], "double", "n", batch=1)
    assert [r.n for r in got.collect()] == [1.0, 1.0]
    cut = df.select(F.array(F.lit(3.0), F.lit(4.0), F.lit(5.0)).alias("v")).select(models.truncated(F.col("v"), 2).alias("v")).first()
    assert list(cut.v) == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize("n", [0, 1, 2, 7, 256, 257, 1000])
def test_range_place(spark, n):
    from bisect import bisect_left

    from lumenfold.functions.ranges import range_place

    bounds = [3 * i for i in range(n)]
    xs = [-1, 0, 1, 3, 5, 3 * n // 2, 3 * n - 4, 3 * n - 3, 3 * n, 10**6, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x long")
    got = [r.p for r in df.select("i", range_place(F.col("x"), bounds).alias("p")).orderBy("i").collect()]
    assert got == [0 if x is None else bisect_left(bounds, x) for x in xs]
