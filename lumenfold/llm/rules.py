"""Quality rules: a threshold table compiled into one projection of native expressions (operator 4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import GAP_CHARS, WORD_GAP, text_of

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is it that for on with as was by an are this be at from or a have not "
    "de la le les et des en un une du que qui dans pour pas sur est par au avec "
    "der die und den von zu das mit sich dem nicht ein eine im auf als ist für "
    "el los las y del se con no una su al lo es para"
).split()
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Threshold:
    """A row is kept if low <= metric <= high (None: open); only judged once `over` words are there."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    over: int = 0


#: The production table: length, symbol, stop-word and line ratios.
TABLE = (
    Threshold("word_length", "mean_word_chars", 1.5, 15.0),
    Threshold("symbols", "symbol_ratio", None, 0.30),
    Threshold("stop_words", "stop_ratio", 0.02, None, 30),
    Threshold("repeated_lines", "dup_line_ratio", None, 0.60),
    Threshold("shouting", "upper_ratio", None, 0.60),
    Threshold("exclamations", "exclamation_ratio", None, 0.40),
)


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts, one narrow projection after another; each array is a column of its own so that a lambda never rebuilds it."""
    i = F.lit(1).cast("int")
    text = docs.select("doc_id", text_of(docs).alias("t"))
    split = text.select(
        "doc_id",
        "t",
        F.split(F.btrim("t", F.lit(GAP_CHARS)), WORD_GAP).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, GAP_CHARS, "") != "").alias("lines"),
    ).withColumn("w", F.when(F.col("w")[0] == "", F.array().cast("array<string>")).otherwise(F.col("w")))
    counted = split.select(
        "doc_id",
        "t",
        "w",
        F.size("w").alias("n"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.length(F.translate("t", GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.lower(F.rtrim(x, F.lit(".,"))).isin(STOP_WORDS) & ~x.rlike("^[A-Z]{2}"))).alias("n_stop"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).alias("n_exclaim"),
    )
    # 36 bits of a window's hash above 28 bits of its place: sorting puts equal windows side by side
    packed = counted.withColumn(
        "p",
        F.when(
            F.col("n") >= 5,
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 5),
                lambda k: F.shiftleft(F.xxhash64(F.get("h", k), F.get("h", k + 1), F.get("h", k + 2), F.get("h", k + 3), F.get("h", k + 4)), 28).bitwiseOR(k.cast("long")),
            ),
        ).otherwise(F.array().cast("array<long>")),
    ).drop("h")
    ordered = packed.withColumn("p", F.sort_array("p"))

    def alike(values, x, k, key):
        return F.coalesce(key(F.get(values, k - i)) == key(x), F.lit(False)) | F.coalesce(key(F.get(values, k + i)) == key(x), F.lit(False))

    top = lambda x: F.shiftrightunsigned(x, 28)
    flagged = ordered.withColumn("p", F.filter("p", lambda x, k: alike("p", x, k, top)))
    # equal bits are only candidates: the words themselves decide
    spelled = flagged.withColumn(
        "p",
        F.sort_array(F.transform("p", lambda x: F.struct(F.array_join(F.slice("w", x.bitwiseAND(F.lit((1 << 28) - 1)).cast("int") + 1, 5), " ").alias("s"), x.bitwiseAND(F.lit((1 << 28) - 1)).cast("int").alias("at")))),
    )
    repeated = spelled.withColumn("p", F.filter("p", lambda x, k: alike("p", x, k, lambda y: y["s"])))
    places = repeated.withColumn("p", F.sort_array(F.transform("p", lambda x: x["at"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    return places.withColumn(
        "n_repeat_words",
        F.aggregate("p", start, lambda a, x: F.struct((x + 5).alias("end"), (a["sum"] + x + 5 - F.greatest(a["end"], x)).alias("sum")), lambda a: a["sum"]),
    )


def _ratio(top: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, table: tuple[Threshold, ...] = TABLE) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): counts, ratios, base_failed, failed_rules, kept.

    A null text has no words; an empty text likewise: n_words 0, base_failed, not kept. A null doc_id is passed on.
    Repeated rows are judged each by itself. The thresholds become one conjunction of comparisons in a projection.
    """
    m = _measured(docs).select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n"))).alias("base_failed"),
        _ratio("word_chars", "n").alias("mean_word_chars"),
        _ratio("n_symbols", "n").alias("symbol_ratio"),
        _ratio("n_stop", "n").alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_upper", "word_chars").alias("upper_ratio"),
        _ratio("n_exclaim", "n").alias("exclamation_ratio"),
    )
    broken = []
    for r in table:
        x = F.lit(False)
        if r.low is not None:
            x = x | (F.col(r.metric) < r.low)
        if r.high is not None:
            x = x | (F.col(r.metric) > r.high)
        broken.append(F.when(x & (F.col("n_words") >= r.over), F.lit(r.name)))
    return m.withColumn("failed_rules", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


#: The counts and verdict in DuckDB SQL, for the production table.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i AS pos, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
u AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, coalesce(nxt - pos, 5)))::BIGINT AS n FROM (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS nxt FROM u) GROUP BY r),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
             (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(rtrim(x, '.,')) IN (@STOP@) AND NOT regexp_matches(x, '^[A-Z]{2}'))) AS n_stop,
             len(l) AS n_lines, len(t) - len(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
             len(t) - len(replace(t, '!', '')) AS n_exclaim
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND word_chars / n_words BETWEEN 1.5 AND 15.0 AND n_symbols / n_words <= 0.30
       AND (n_words < 30 OR n_stop / n_words >= 0.02) AND n_dup_lines / n_lines <= 0.60
       AND n_upper / word_chars <= 0.60 AND n_exclaim / n_words <= 0.40 AS kept
FROM m
""".replace("@STOP@", ", ".join(f"'{x}'" for x in STOP_WORDS))


def query(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
