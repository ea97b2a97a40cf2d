"""Bounded samples of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool


def remainder(folds: int) -> Column:
    """Of the crc32 of doc_id as text; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, column: str, usable: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) of at most ``per_class`` documents of each class, and how many usable labels each class has.

    Those with the smallest hash of doc_id are taken, so the sample doesn't depend on partitions. Labels other than 0 and 1
    don't count; a document with several labels takes the largest. A doc_id that repeats brings one of its texts.
    """
    own = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    ids = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # the ids are at most 2 x per_class, whatever the input
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    return spool(found, "sample"), counts
