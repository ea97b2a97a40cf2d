"""Language of web pages from several kinds of evidence.

Method: Bayesian fusion. The log posterior of a language adds

- the likelihood of the visible text under letter n-gram models fitted on labelled documents,
- the likelihood of the language that the markup declares,
- the likelihood of the address's suffix, and
- a prior of the host, smoothed towards the prior of its domain, and that towards the prior of all pages.

How far a declaration, a suffix or a host speaks for a language isn't assumed: grouped sums of the text-only posteriors over all pages
say so, each page's own share taken out. A hot host is pre-aggregated before the shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, spool

#: Labelled documents of a language that its text model is fitted on, and n-grams of the model, at most.
PER_LANGUAGE, NGRAMS = 1500, 60_000
#: Letters that count as a word at most; a longer run is as many words as it has windows of this length.
WINDOW = 40
#: Words that a text counts as at most; pages that a smoothed estimate weighs its parent as.
TEXT_WORDS, PARENT = 40.0, 20.0

_DROP = re.compile(r"<(script|style|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>", re.I | re.S)
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def visible(page: str) -> str:
    return html.unescape(_DROP.sub(" ", page))


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain: its last two labels, suffix: its last), lower-case; None where there is no host."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = [x for x in host.split(".") if x]
    return (host, ".".join(labels[-2:]), labels[-1]) if labels else (None, None, None)


def ngrams(word: str) -> list[str]:
    """Of lengths one to three, with the word's ends marked."""
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


def words_of(text: str) -> Counter[str]:
    """Runs of letters in lower case, long ones in windows, and how often each stands in the text."""
    out: Counter[str] = Counter()
    for run, n in Counter(_WORD.findall(text.lower())).items():
        for i in range(0, len(run), WINDOW):
            out[run[i : i + WINDOW]] += n
    return out


@dataclass
class TextModel:
    languages: list[str]
    #: log probabilities of n-grams by language, and of one never seen
    seen: dict[str, np.ndarray]
    unseen: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        """Mean log probability of a word's n-grams, in each language, times three."""
        grams = ngrams(word)
        return sum((self.seen.get(g, self.unseen) for g in grams), np.zeros(len(self.languages))) * (3.0 / len(grams))

    def log_likelihood(self, text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, int]:
        """Of a text as of TEXT_WORDS words at most (words near each other aren't independent), and its words."""
        total, n = np.zeros(len(self.languages)), 0
        for word, count in words_of(text).items():
            got = known.get(word)
            if got is None:
                if len(known) > 300_000:
                    known.clear()
                got = known[word] = self.of_word(word)
            total += count * got
            n += count
        return total * min(1.0, TEXT_WORDS / max(n, 1)), n


def text_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> TextModel:
    """Fitted on at most ``per_language`` labelled documents (columns text, lang) of each language, those with the smallest hashes."""
    named = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    top = [r["lang"] for r in named.select("lang").distinct().collect()]
    # ranked in 64 shares of each language first, so that no language is gathered whole
    ranked = named.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h"))).where(F.col("r") <= per_language)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    rows = ranked.where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("most"))
    if not top:
        return TextModel(["und"], {}, np.zeros(1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, Counter())
                for word, n in words_of(text).items():
                    for g in ngrams(word):
                        own[g] += n
        for lang, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own, pa.string()), pa.array(own.values(), pa.int64())], ["lang", "gram", "n"])

    picked = named.join(F.broadcast(rows), "lang").where("h <= most").select("lang", "text")  # a row per language is broadcast
    grams = spool(picked.mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "ngrams")
    most = grams.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(NGRAMS)
    got = grams.join(most, "gram").select("lang", "gram", "n").toArrow()
    languages = sorted(top)
    place = {lang: i for i, lang in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for lang, gram, n in zip(got["lang"].to_pylist(), got["gram"].to_pylist(), got["n"].to_pylist(), strict=True):
        counts.setdefault(gram, np.zeros(len(languages)))[place[lang]] += n
    total = sum(counts.values(), np.zeros(len(languages))) + 0.5 * (len(counts) + 1)
    return TextModel(languages, {g: np.log((c + 0.5) / total) for g, c in counts.items()}, np.log(0.5 / total))


def page_language(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, suffix, host and n_words; a row per row of ``pages`` (page_id, url, html).

    Null or empty html has no text and no declaration, a null or broken url no host and no suffix: that evidence is left out, and
    with none at all the prior of all pages decides. Ties go to the first language by name. Repeated rows stay; extra columns are left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a bounded number of n-grams and languages
    kind, names, n = pages.schema["page_id"].dataType.simpleString(), model.languages, len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = page or ""
                ll, words = model.log_likelihood(visible(page), known)
                said = _DECLARED.search(page)
                rows.append((*address(url), said[1].lower() if said else None, words, (ll - ll.max()).tolist()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["page_id", "host", "domain", "suffix", "declared", "n_words", "ll"])

    seen = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, host string, domain string, suffix string, declared string, n_words long, ll array<double>")
    # text-only posteriors under equal priors
    p = spool(seen.withColumn("p", _softmax(F.col("ll"))), "pages")

    def sums(key: str | None) -> DataFrame:
        held = p.where(F.col(key).isNotNull()).groupBy(key) if key else p.groupBy()
        return held.agg(F.array(*(F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)) for i in range(n))).alias(f"{key or 'all'}_sum"))

    whole = F.broadcast(sums(None))  # one row
    joined = p.crossJoin(whole)
    for key in ("host", "domain", "suffix", "declared"):
        joined = joined.join(spool(sums(key), "evidence"), key, "left")

    def smoothed(key: str, parent: Column) -> Column:
        """Share of each language among the other rows of the group, with PARENT rows of the parent's shares."""
        return F.when(F.col(f"{key}_sum").isNull(), parent).otherwise(
            bind(F.zip_with(f"{key}_sum", "p", lambda c, own: F.greatest(c - own, F.lit(0.0))), lambda c: F.zip_with(c, parent, lambda x, q: (x + PARENT * q) / (_total(c) + PARENT)))
        )

    prior = F.transform("all_sum", lambda x: (x + 1.0) / (_total(F.col("all_sum")) + n))
    host = smoothed("host", smoothed("domain", prior))
    joined = joined.withColumn("prior", prior).withColumn("post", F.zip_with(F.transform(host, F.ln), "ll", lambda a, b: a + b))
    for key in ("suffix", "declared"):
        # P(value | language) up to a factor: share of the language in the group over its share in all
        ratio = F.zip_with(smoothed(key, F.col("prior")), "prior", lambda a, b: F.ln(a / b))
        joined = joined.withColumn("post", F.zip_with("post", ratio, lambda a, b: a + b))
    named = F.array(*map(F.lit, names))
    first = lambda c: F.get(named, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    out = joined.withColumn("post", _softmax(F.col("post")))
    return out.select("page_id", first(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"), F.when(F.col("n_words") > 0, first(F.col("ll"))).alias("text_lang"), "declared", "suffix", "host", "n_words")


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _softmax(c: Column) -> Column:
    raised = bind(c, lambda v: F.transform(v, lambda x: F.exp(F.greatest(x - F.array_max(v), F.lit(-700.0)))))
    return bind(raised, lambda v: F.transform(v, lambda x: x / _total(v)))
