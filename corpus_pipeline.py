"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps. All but the last return
the columns of documents.

Edge cases, stage after stage: a null text is an empty one, kept or not by its score, one group with all texts without words, unchanged
by substring dedup, and a document of one id in packing. A null doc_id stays where its group of near copies has no other. Repeated rows are
copies: one stays. Ties go to the lesser doc_id, then to the first row. A null source is a source of its own. Very long texts are judged whole in
every stage. Further columns, whatever their names, pass through all stages but the last. A table without rows gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import lines, mixing, packing, simhash, substrings
from lumenfold.llm.shared import Scratch

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker remembers: few, as workers live on into the next job's stages.
CACHE = 600_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier calls good; it learns from the labels outside the held-out fold."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return lines.only_good(docs, labels, taught_by=documents)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each_group(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in windows that repeat anywhere; n_chars follows the text."""
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order whose every stretch holds the sources by their target weights."""
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), cache=CACHE)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_substrings),
    ("mixing sources", mix),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the fingerprints' components; tests compare each stage with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
