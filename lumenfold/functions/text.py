"""Scalar text functions as native column expressions; each has its DuckDB twin in plans/oracle.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of tokens, of units of cost, of sentence ends and of labels.
TOKEN = r"[A-Za-z0-9_]+|[\p{L}\p{N}_]"
COST_TOKEN = r"[A-Za-z0-9_]+|[^\x00-\x7F]"
BOUNDARY = r"(?<=[.!?。！？])\s+(?=[A-Z0-9一-鿿])"
FIGURE_LABEL = r"(?i)\bfig(?:ure)?\.?\s*(\d+[a-z]?)"
TABLE_LABEL = r"(?i)(?:\btab(?:le)?\.?\s*|表\s*)(\d+[a-z]?)"
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ("Fig", "Figs", "Eq", "Eqs", "Ref", "Refs", "et al", "i.e", "e.g")
ABBREVIATION = "(" + "|".join(x.replace(".", r"\.") for x in sorted(ABBREVIATIONS, reverse=True)) + r")\."
_HELD = "\x01"


def casefolded(c: Column) -> Column:
    """Lower case with sharp s spelt out (full case folding for the letters that occur)."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    """Runs of ASCII word characters, and every other letter or digit by itself, case folded."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), casefolded)


def token_cost(c: Column) -> Column:
    """Text-token proxy: runs of ASCII word characters and single non-ASCII characters, at least one."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(COST_TOKEN), F.lit(0)))).cast("long")


def node_cost(node_type: Column, text: Column, image_path: Column, image_unit: int = 512) -> Column:
    """A figure costs an image; a table its tokens and, with an image, an image; the rest their tokens."""
    with_image = F.when(image_path.isNotNull() & (image_path != ""), F.lit(image_unit)).otherwise(0)
    return F.when(node_type == "Figure", F.lit(image_unit).cast("long")).when(node_type == "Table", token_cost(text) + with_image).otherwise(token_cost(text)).cast("long")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def sentence_parts(c: Column) -> Column:
    """Pieces between sentence ends that a capital, digit or ideograph follows; abbreviations' dots don't end a sentence."""
    held = F.regexp_replace(collapsed(c), ABBREVIATION, "$1" + _HELD)
    return F.filter(F.transform(F.split(held, BOUNDARY), lambda p: F.trim(F.translate(p, _HELD, "."))), lambda p: p != "")


def folded_sentences(parts: Column, least: int = 8) -> Column:
    """Pieces of under `least` characters joined to the sentence before, if there is one.

    `parts` must be a column of its own (it is looked up by place for every sentence).
    """
    heads = F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | (F.length(p) >= least), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(heads, 2, F.greatest(F.size(parts), F.lit(1))), F.array(F.size(parts)))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.zip_with(heads, ends, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), " "))
    )


def figure_labels(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(FIGURE_LABEL), F.lit(1)), F.lower))


def table_labels(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(TABLE_LABEL), F.lit(1)), F.lower))


def words_of_answer(c: Column) -> Column:
    return F.regexp_extract_all(casefolded(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def normalized_answer(c: Column) -> Column:
    return F.array_join(words_of_answer(c), " ")


def l2_normalized(v: Column) -> Column:
    """v must be a column of its own."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def grouped_split(group: Column, train: int = 70, dev: int = 15) -> Column:
    """train, dev or test by the first four bytes of the group's SHA-1, so that a group is never split."""
    bucket = F.conv(F.substring(F.sha1(group), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < train, "train").when(bucket < train + dev, "dev").otherwise("test")


def safe_name(c: Column) -> Column:
    """The last 60 characters with only ASCII word characters, dots and dashes, and a digest of the whole."""
    return F.concat(F.regexp_replace(F.right(c, F.lit(60)), r"[^A-Za-z0-9._-]+", "_"), F.lit("-"), F.substring(F.sha1(c), 1, 12))


def uuid5_of(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Version 5 UUID of a name in a namespace (URLs by default)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def numeric(c: Column) -> Column:
    """A number without thousands commas and trailing percent signs, else null."""
    return F.rtrim(F.replace(c, F.lit(","), F.lit("")), F.lit("%")).try_cast("double")


def fences_stripped(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:csv)?\s*|\s*```$", ""), r"^csv\s*\n", ""))
