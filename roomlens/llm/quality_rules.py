"""Quality rules whose cutoffs carry a bound on the share of good documents they reject.

Method: risk-controlled thresholds. Each rule rejects a document whose metric
lies above a cutoff. For every stratum (a class of text lengths), rule and cutoff of a
fixed grid, the labelled good documents are counted, and those the rule
would reject. An exact binomial bound says whether the true share of false rejections is
below the allowed one. Within a stratum and a rule the cutoffs are tested from the most lenient one
on, up to the first that fails (fixed-sequence testing, which needs no correction);
over strata x rules the level is divided (Bonferroni). So with probability 1 - ``level`` every
selected cutoff keeps its promise. The strictest certified cutoff is taken; without one
the rule is off in that stratum.

All of it is DataFrame expressions. The texts are read once; only counts go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bind, spool

SYMBOLS = "#*$%&|<>"
_SPACES = r"[\x20\x09-\x0D]+"

#: Metric above which a document is junk, and the cutoffs that are tried.
RULES = {
    "symbols_per_word": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "dup_lines_per_line": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "chars_per_word": (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0),
}
#: Words from which a stratum begins.
STRATA = (10, 150, 600)
#: Terms of a binomial tail that are summed, enough to the last digit for 10^8 labels; the rest is bounded by a geometric series.
TAIL_TERMS = 20_000


@dataclass(frozen=True)
class Risk:
    """``share``: of good documents in a stratum that all rules together may reject; ``level``: chance that it is more."""

    share: float = 0.03
    level: float = 0.05


def word_stats(docs: DataFrame) -> DataFrame:
    """doc_id, row (xxhash64 of the text) and the counts of each text; one row per row of ``docs``.

    Null text counts as empty. Repeated rows stay repeated. n_lines counts the lines that hold a word.
    n_repeat_words compares five-word windows by 64-bit hash inside one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("t"))
    d = d.select(
        "doc_id",
        F.xxhash64("t").alias("row"),
        F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(
            F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            lambda lines: F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup")),
        ).alias("lines"),
        bind(
            F.filter(F.split("t", _SPACES), lambda w: w != ""),
            lambda words: F.struct(F.size(words).alias("n"), bind(_windows(words), _repeat_words).alias("repeats")),
        ).alias("words"),
    )
    return d.select(
        "doc_id",
        "row",
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        F.col("words.repeats").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
    )


def _windows(words: Column) -> Column:
    at = F.when(F.size(words) >= 5, F.sequence(F.lit(1), F.size(words) - 4)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(5))))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s):
        same = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def covered(at):
        return F.aggregate(F.transform(at, lambda i, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - i, F.lit(5)))), F.lit(0), lambda n, x: n + x)

    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0)).otherwise(bind(bind(ordered, twice), covered))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _metrics(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    stratum = F.lit(0)
    for least in STRATA:
        stratum = stratum + (F.col("n_words") >= least).cast("int")
    return stats.withColumns(
        {
            "symbols_per_word": F.col("n_symbols") / words,
            "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "chars_per_word": F.col("word_chars") / words,
            "stratum": stratum,
        }
    )


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z >= 1, to 12 digits: Stirling's series after a shift by 8."""
    y = z + 8.0
    product = z
    for k in range(1, 8):
        product = product * (z + float(k))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + series - F.ln(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) for a chance ``p``: exact, or a little more beyond TAIL_TERMS terms; 1 where k >= n p."""
    k, n = k.cast("double"), n.cast("double")
    odds = (1 - p) / p
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(TAIL_TERMS)).cast("int"))
    summed = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, j: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (k - j) * odds / (n - k + j + 1)).alias("term")),
    )
    ratio = k * odds / (n - k + 1)
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * (summed["sum"] + summed["term"] / (1 - F.least(ratio, F.lit(1 - 1e-9))))))


def thresholds(stats: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum: the least certified cutoff of each rule, null where none is.

    Labelled good documents are those with quality 1 that the base rules keep. A document labelled more than once
    counts as good if all its labels say so. Null labels and labels without a document don't count.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    m = _metrics(stats.where(~base_failed()).join(good, "doc_id", "left_semi"))
    share, level = risk.share / len(RULES), risk.level / (len(STRATA) * len(RULES))
    counts = m.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"),
        *(F.sum((F.col(rule) > cut).cast("long")).alias(f"{rule}_{i}") for rule, cuts in RULES.items() for i, cut in enumerate(cuts)),
    )
    # one pass for all tests, then a row of results per stratum
    passed = counts.select("stratum", *((binomial_tail(F.col(f"{rule}_{i}"), F.col("n_good"), share) <= level).alias(f"{rule}_{i}") for rule, cuts in RULES.items() for i in range(len(cuts))))
    chosen = {}
    for rule, cuts in RULES.items():
        chosen[rule] = F.lit(None).cast("double")
        for i in range(len(cuts)):  # the strictest that passes with all more lenient ones
            so_far = F.lit(True)
            for k in range(i, len(cuts)):
                so_far = so_far & F.col(f"{rule}_{k}")
            chosen[rule] = F.coalesce(chosen[rule], F.when(so_far, F.lit(cuts[i])))
    return passed.select("stratum", *(c.alias(f"cut_{rule}") for rule, c in chosen.items()))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, counts, base_failed, kept, rejected_by (array of rule names) and row (xxhash64 of the text); one row per row of ``docs``.

    Null text: no words, so it fails the base rules. Without labels only the base rules reject. Extra columns are
    ignored. Repeated rows get the same verdict each. The thresholds, a row for each of at
    most len(STRATA) + 1 strata, are all that is broadcast.
    """
    stats = spool(word_stats(docs), "rules")
    cuts = F.broadcast(thresholds(stats, labels, risk))
    m = _metrics(stats).join(cuts, "stratum", "left")
    hits = F.array_compact(F.array(*(F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES)))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (F.size(hits) == 0)).alias("kept"), hits.alias("rejected_by"), "row",
    )


def passing(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    stay = quality_rules(docs, labels, risk).where("kept").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__row")), "left_semi")
