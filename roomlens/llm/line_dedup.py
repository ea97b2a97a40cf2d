"""Lines that many documents share, dropped everywhere but in one document.

Method: two Bloom filters over the hashes of line keys, of those seen in one document and those seen in two
(see twice.py). Only lines that the second filter suspects are shuffled; among them the exact
keys are counted by document, and the document that keeps its lines is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bind, lower_ascii, spool
from .twice import bits_for, keep_suspected, twice_filter


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, filter_bits: int | None = None) -> DataFrame:
    """``docs`` with ``text`` after the drop, n_lines (before it) and n_dropped.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents (distinct doc_id; a null one counts as a
    document below all others) loses its lines except in the largest doc_id that holds it; that one keeps all of them. Null
    text counts as one empty line and comes back empty. Repeated rows are one document and are cut alike.
    All other columns pass through; columns named n_lines or n_dropped are replaced. filter_bits: size of the filters, by default by the number of lines.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), _lines().alias("lines"))
    keys = rows.select(F.explode(F.array_distinct(F.filter(F.transform("lines", line_key), lambda k: F.length(k) >= min_chars))).alias("key"))
    if filter_bits is None:
        lines = docs.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0]
        filter_bits = bits_for(lines or 0)
    found = twice_filter(keys.select(F.xxhash64("key").alias("h")), filter_bits)

    placed = rows.select("doc_id", "row", F.posexplode("lines").alias("at", "line"))
    placed = placed.select("doc_id", "row", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    suspects = spool(keep_suspected(placed.withColumn("h", F.xxhash64("key")), "h", found).drop("h"), "lines")
    shared = suspects.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    # written, so that both sides of the join are shuffled by key and a hot key can be split
    gone = suspects.join(spool(shared, "shared"), "key").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("at").alias("__gone"))

    cut = docs.drop("n_lines", "n_dropped").withColumn("__hash", F.xxhash64("text"))
    cut = cut.join(gone, cut["doc_id"].eqNullSafe(gone["__id"]) & (cut["__hash"] == gone["__row"]), "left")
    kept = bind(
        _lines(),
        lambda lines: F.struct(
            F.size(lines).cast("long").alias("n"),
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i)), "\n").alias("text"),
        ),
    )
    whole = F.struct(F.size(_lines()).cast("long").alias("n"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = cut.withColumn("__cut", F.when(F.col("__gone").isNull(), whole).otherwise(kept))
    cut = cut.withColumns({"text": F.col("__cut.text"), "n_lines": F.col("__cut.n"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
    return cut.drop("__hash", "__id", "__row", "__gone", "__cut")
