import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roomlens.llm import quality_rules as Q

LABELS = "doc_id long, quality int, toxic int, stratum int"


def brute(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark, edge_docs, edge_rows):
    labels = spark.createDataFrame([(1, 1, 0, 9), (1, 0, 0, 9), (2, None, 0, 9), (None, 1, 0, 9), (999, 1, 0, 9)], LABELS)
    got = Q.quality_rules(edge_docs, labels).collect()
    want = Counter()
    for i, t in edge_rows:
        n = brute(t)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want[(i, *n, failed, not failed)] += 1  # too few labels for any rule
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert Q.passing(edge_docs, labels).columns == edge_docs.columns
    assert Q.passing(edge_docs, labels).count() == sum(n for k, n in want.items() if k[-1])


def test_empty(no_docs, spark):
    none = spark.createDataFrame([], LABELS)
    assert Q.quality_rules(no_docs, none).count() == 0
    assert Q.passing(no_docs, none).count() == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.2), (3, 1000, 0.01), (40, 1000, 0.05), (0, 5000, 0.01), (9, 1200, 0.02), (400, 50_000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(Q.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def test_binomial_tail_is_one_above_the_mean(spark):
    assert spark.range(1).select(Q.binomial_tail(F.lit(30), F.lit(1000), 0.02)).first()[0] == 1.0


def test_cutoffs_hold_their_promise(spark):
    """Good documents hold no symbols but for a few; junk does. The rule comes on, and rejects no more than it may."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, words + (" ####" * 10 if i < 3 else "")) for i in range(3000)] + [(5000 + i, words.replace(" ", "#### ")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5000), 0, 0) for i, _ in rows], LABELS)
    got = Q.quality_rules(docs, labels).groupBy((F.col("doc_id") < 5000).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.good: r.kept for r in got}
    assert kept[False] == 0.0
    assert kept[True] >= 1 - Q.Risk().share


def test_a_failing_lenient_cutoff_hides_stricter_ones(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, words.replace(" ", "# ") if i % 20 == 0 else words) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0, 0) for i, _ in rows], LABELS)
    cuts = Q.thresholds(Q.word_stats(docs), labels).collect()
    assert all(r.cut_symbols_per_word is None or r.cut_symbols_per_word >= 0.5 for r in cuts)
