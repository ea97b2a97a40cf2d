"""The queries of this subpackage and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .bpe import bpe_encode
from .common import table
from .embedding_dups import embedding_links
from .language import page_language, text_model
from .line_dedup import line_dedup
from .packing import pack
from .quality_model import quality_model, quality_scores
from .quality_rules import RULES, STRATA, Risk, quality_rules
from .sample import remainder
from .simhash import simhash_groups
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity, toxicity_index


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(remainder(3) == 1, F.lit(False))
    scored = quality_scores(docs, quality_model(docs, table(spark, sf_dir, "labels"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_language(table(spark, sf_dir, "pages"), text_model(table(spark, sf_dir, "documents").select("text", "lang")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


_OP6_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
sound AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM sound),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_inner_product(a.u, b.u) >= 0.9),
reached AS (SELECT a AS vec_id, a AS least FROM links UNION SELECT a AS vec_id, b AS least FROM links UNION SELECT l.b AS vec_id, r.least FROM reached r JOIN links l ON l.a = r.vec_id),
least AS (SELECT vec_id, min(least) AS least FROM reached GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(least, e.vec_id) AS component_id, coalesce(least, e.vec_id) = e.vec_id AS kept FROM e LEFT JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by", "row")


def _op9_sql() -> str:
    risk = Risk()
    share, level = risk.share / len(RULES), risk.level / (len(STRATA) * len(RULES))
    stratum = " + ".join(f"(n_words >= {x})::int" for x in STRATA)
    grid = ", ".join(f"('{rule}', {cut})" for rule, cuts in RULES.items() for cut in cuts)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, t, doc_id FROM d),
win AS (SELECT r, i, array_to_string(words[i : i + 4], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
s AS (SELECT w.r, doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN rep ON rep.r = w.r),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {stratum} AS stratum,
             n_symbols / greatest(n_words, 1)::double AS symbols_per_word, n_dup_lines / greatest(n_lines, 1)::double AS dup_lines_per_line,
             word_chars / greatest(n_words, 1)::double AS chars_per_word FROM s),
long AS (SELECT r, doc_id, stratum, base_failed, rule, value FROM m UNPIVOT (value FOR rule IN ({", ".join(RULES)}))),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, cut) AS (VALUES {grid}),
tests AS (SELECT stratum, g.rule, cut, count(*) AS n, count(*) FILTER (value > cut) AS k
          FROM long JOIN good USING (doc_id) JOIN grid g ON g.rule = long.rule WHERE NOT base_failed GROUP BY ALL),
tail AS (SELECT stratum, rule, cut, CASE WHEN k >= n * {share} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share}))) FROM (SELECT unnest(range(0, k + 1)) AS j)) END AS p FROM tests),
run AS (SELECT *, bool_and(p <= {level}) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS ok FROM tail),
chosen AS (SELECT stratum, rule, min(cut) AS cut FROM run WHERE ok GROUP BY ALL),
rejected AS (SELECT DISTINCT r FROM long JOIN chosen USING (stratum, rule) WHERE value > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected.r IS NULL AS kept
FROM m LEFT JOIN rejected USING (r)"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(remainder(5) == 0, F.lit(False))
    scored = toxicity(docs, toxicity_index(docs, table(spark, sf_dir, "labels"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_embedding_dups": op6_embedding_dups,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op6_embedding_dups": _OP6_SQL, "op7_line_dedup": _OP7_SQL, "op9_quality_rules": _op9_sql()}
