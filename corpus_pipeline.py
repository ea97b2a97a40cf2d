"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with text and n_chars
as the stage left them. A stage sees all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlens.llm.common import spool, table
from roomlens.llm.line_dedup import line_dedup
from roomlens.llm.packing import pack
from roomlens.llm.quality_rules import passing
from roomlens.llm.similar import similar_groups
from roomlens.llm.simhash import one_of_each
from roomlens.llm.suffix_dedup import suffix_dedup


#: Bytes of a passage: over 50 words of five bytes each, with the spaces.
PASSAGE = 256


def _changed(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``cut``, with n_chars of the new text."""
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return passing(docs, table(spark, sf_dir, "labels"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; no document goes."""
    return _changed(docs, line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 0.8 similar or more, one of each group stays: that with the smallest doc_id."""
    return one_of_each(docs, similar_groups(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again are cut from the texts; no document goes."""
    return _changed(docs, suffix_dedup(docs, PASSAGE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", shared_lines),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packing),
]

#: Tokens and binary-safe cuts are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
