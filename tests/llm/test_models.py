import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlens.llm import language as G
from roomlens.llm import queries as Q
from roomlens.llm import quality_model as M
from roomlens.llm import toxicity as T
from roomlens.llm.sample import remainder

LABELS = "doc_id long, quality int, toxic int, score double"


@pytest.mark.parametrize(("name", "column", "folds", "held"), [("op1_quality_model", "quality", 3, 1), ("op10_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, column, folds, held):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES[name](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.score.between(0, 1).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == held for i in got.doc_id]).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both[column]).mean() > (0.95 if column == "quality" else 0.88)


def test_odd_documents(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0, 0.0), (1, 0, 1, 0.0), (2, None, None, 0.0), (None, 1, 1, 0.0), (999, 1, 1, 0.0), (30, 0, 1, 0.0), (20, 1, 0, 0.0)], LABELS)
    for some in (labels, labels.limit(0)):
        model = M.quality_model(edge_docs, some, remainder(3) != 1)
        scores = M.quality_scores(edge_docs, model)
        assert scores.count() == edge_docs.count()
        assert scores.where("score is null or score < 0 or score > 1").count() == 0
        index = T.toxicity_index(edge_docs, some, remainder(5) != 0)
        scores = T.toxicity(edge_docs, index)
        assert scores.count() == edge_docs.count()
        assert scores.where("score is null or score < 0 or score > 1").count() == 0
        assert M.quality_scores(no_docs, model).count() == T.toxicity(no_docs, index).count() == 0
    M.quality_model(no_docs, labels, remainder(3) != 1)
    T.toxicity_index(no_docs, labels, remainder(5) != 0)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (6000, len(M.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = M.fit(x[:4000], y[:4000], np.ones(4000))
    assert ((model.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.9
    assert (0, 1) in model.pairs
    table_sum = model.base + sum(t[np.searchsorted(e, v)] for t, e, v in zip(model.tables, model.edges, x[0], strict=True))
    table_sum += sum(t[np.searchsorted(model.pair_edges[f], x[0, f]), np.searchsorted(model.pair_edges[g], x[0, g])] for (f, g), t in zip(model.pairs, model.pair_tables, strict=True))
    assert model.logit(x[:1])[0] == pytest.approx(table_sum)


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    n, terms = 500, 80
    counts = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(terms, rng.integers(0, 12), replace=False)} for _ in range(n)]
    df = np.bincount([t for c in counts for t in c], minlength=terms).astype(float)
    index = T.build([f"t{i}" for i in range(terms)], df, n, np.arange(n), rng.integers(0, 2, n), counts, {0: 1.0, 1: 1.0})
    dense = np.zeros((n, terms))
    for e, c in enumerate(counts):
        at, w = T.unit(c, index.idf)
        dense[e, at] = w
    for e in range(0, n, 7):
        at, w = T.unit(counts[e], index.idf)
        best, cos = index.nearest(at, w, 10, but=e)
        want = dense @ dense[e]
        want[e] = -1
        order = [i for i in np.lexsort((np.arange(n), -np.round(want, 6))) if want[i] > 1e-6][:10]
        assert best.tolist() == order
        assert cos == pytest.approx(want[order], abs=2e-6)


def test_language_of_pages(spark):
    pages = [(1, "https://a.site.de/x", '<html lang="de"><p>der und die das ist nicht ein</p>'), (2, "https://a.site.de/y", "<html><script>the of and</script><p>und der die ein</p>"), (3, None, None), (4, "not a url", ""), (5, "https://a.site.de/z", ""), (None, "http://b.org", '<html lang=en><b>the of and to in that</b>'), (6, "http://[bad", "<<<<" * 1000 + "the of and"), (1, "https://a.site.de/x", '<html lang="de"><p>der und die das ist nicht ein</p>')]
    docs = spark.createDataFrame([("de", "der und die das ist nicht ein"), ("en", "the of and to in that is"), (None, "x"), ("de", None)], "lang string, text string")
    model = G.text_model(docs)
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, lang string, prior int")
    got = G.page_language(df, model).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert (by[1].lang, by[2].lang, by[None].lang) == ("de", "de", "en")
    assert by[5].lang == "de"  # nothing but its host speaks
    assert by[3].host is None
    assert by[3].text_lang is None
    assert all(0 < r.confidence <= 1 for r in got)
    assert G.page_language(df.limit(0), model).count() == 0
    assert G.text_model(docs.limit(0)).languages == ["und"]


def test_language_posterior_as_brute_force(spark):
    """The fused posterior, from the operator's own text likelihoods, by hand."""
    pages = [(i, f"http://{'ab'[i % 2]}.{'xy'[i % 3 == 0]}.{'de' if i % 2 else 'com'}/p", f"<html lang={'de' if i % 4 else 'en'}><p>{'der und die' if i % 2 else 'the of and'} {'the' * (i % 5)}</p>") for i in range(24)]
    docs = spark.createDataFrame([("de", "der und die das ist"), ("en", "the of and to in")], "lang string, text string")
    model = G.text_model(docs)
    rows = [(G.address(u), G._DECLARED.search(h)[1], model.log_likelihood(G.visible(h), {})[0]) for _, u, h in pages]
    p = np.array([np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum() for *_, ll in rows])
    prior = (p.sum(0) + 1) / (len(p) + 2)

    def smoothed(key, i, parent):
        own = sum(p[j] for j in range(len(p)) if key(j) == key(i)) - p[i]
        own = np.maximum(own, 0)
        return (own + G.PARENT * parent) / (own.sum() + G.PARENT)

    got = {r.page_id: r for r in G.page_language(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    for i in range(len(pages)):
        domain = smoothed(lambda j: rows[j][0][1], i, prior)
        post = np.log(smoothed(lambda j: rows[j][0][0], i, domain)) + rows[i][2]
        for key in (lambda j: rows[j][0][2], lambda j: rows[j][1]):
            post = post + np.log(smoothed(key, i, prior) / prior)
        post = np.exp(post - post.max())
        post /= post.sum()
        assert got[i].lang == model.languages[int(post.argmax())]
        assert got[i].confidence == pytest.approx(post.max(), rel=1e-6)


def test_rare_insults_and_copies_have_neighbours(spark):
    """A term in 3 of 4,000 toxic examples is evidence, and so is a verbatim copy of an example made of ordinary words."""
    ordinary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(ordinary[i] for i in rng.integers(0, 80, n))
    rows = [(i, f"{say(8)} grobian" if i < 4000 else say(8), int(i < 4000)) for i in range(8000)]
    rows[:3] = [(i, f"{say(8)} zwackel", 1) for i in range(3)]
    rows[3] = (3, " ".join(ordinary[:30]), 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    index = T.toxicity_index(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.lit(True))
    asked = spark.createDataFrame([(9000, "zwackel"), (9001, " ".join(ordinary[:30]))], "doc_id long, text string")
    got = {r.doc_id: r for r in T.toxicity(asked, index).collect()}
    assert set(got[9000].evidence) == {0, 1, 2}
    assert got[9000].score > 0.5
    assert got[9001].evidence[0] == 3


def test_long_runs_count_whole(spark):
    """What comes after the 40th letter of a run counts, and for as many words as it is long."""
    docs = spark.createDataFrame([("de", "der und die das ist nicht ein"), ("en", "the of and to in that is")], "lang string, text string")
    model = G.text_model(docs)
    ll, n = model.log_likelihood("q" * 40 + "theofandtointhat" * 100, {})
    assert model.languages[int(ll.argmax())] == "en"
    assert n == 41
    swapped, _ = model.log_likelihood("q" * 40 + "derunddiedasistnicht" * 100, {})
    assert model.languages[int(swapped.argmax())] == "de"


def test_every_labelled_language_stays(spark):
    docs = spark.createDataFrame([(f"l{k:02}", f"wort{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3}") for k in range(70)] * 2, "lang string, text string")
    assert G.text_model(docs).languages == [f"l{k:02}" for k in range(70)]


def test_toxicity_from_texts_as_brute_force(spark):
    """Terms, weights, cosines, votes and scores of texts, worked out with plain dictionaries."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.zipf(1.6, 3) % 20)
    rows = [(i, " ".join([*(word() for _ in range(int(rng.integers(0, 30)))), *(["scum"] if i % 3 == 0 and i % 2 else [])]), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    index = T.toxicity_index(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.col("doc_id") < 250, 80)
    sample = [(i, t, y) for i, t, y in rows if i in set(index.ids.tolist())]
    assert len(sample) == 160 and sum(y for *_, y in sample) == 80
    counts = {i: T.term_counts(t) for i, t, _ in sample}
    label = {i: y for i, _, y in sample}
    share = {1: 84 / 80, 0: 166 / 80}
    mean = (share[0] + share[1]) / 2

    def weight(term):
        own = [i for i, c in counts.items() if term in c]
        toxic = sum(label[i] for i in own)
        odds = np.log((toxic + 2) / 84 / ((len(own) - toxic + 2) / 84))
        return (np.log(161 / (1 + len(own))) + 1) * (odds**2 + 0.001)

    every = {t: weight(t) for c in counts.values() for t in c}

    def vector(c):
        v = {t: (1 + np.log(n)) * every[t] for t, n in c.items() if t in every}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {i: vector(c) for i, c in counts.items()}
    got = {r.doc_id: r for r in T.toxicity(docs, index).collect()}
    for i, text, _ in rows[200:]:
        own = vector(T.term_counts(text))
        cos = {e: sum(x * v.get(t, 0.0) for t, x in own.items()) for e, v in examples.items()}
        best = sorted((e for e in cos if cos[e] > 1e-6), key=lambda e: -cos[e])[:15]
        kept = [round(cos[e], 5) for e in best]
        assert sorted(round(cos[e], 5) for e in got[i].evidence) == pytest.approx(sorted(kept), abs=2e-5)
        near = got[i].evidence
        w = {e: share[label[e]] / mean / (1.05 - min(cos[e], 1.0)) for e in near}
        vote = (sum(w[e] * label[e] for e in near) + index.prior) / (sum(w.values()) + 1)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(index.slope * np.log(vote / (1 - vote)) + index.shift))), abs=1e-4)
