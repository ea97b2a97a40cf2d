import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from roomlens.llm import queries as Q

from test_line_dedup import brute as lines
from test_suffix_dedup import brute as suffixes


def test_stages_handle_odd_documents(spark, make_docs, edge_rows, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = make_docs(edge_rows).select(*docs.columns)
    for start in (docs.unionByName(odd), odd.limit(0)):
        kept = start
        for name, stage in C.STAGES[:-1]:
            kept = stage(spark, kept, small).cache()
            assert kept.columns == docs.columns, name
            assert kept.where("n_chars <> length(text)").count() == 0 or name == "quality rules"
        assert C.STAGES[-1][1](spark, kept, small).where("offset + length > 1024").count() == 0


def test_run(spark, small):
    pieces = C.run(spark, small).toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    assert pieces.groupby("doc_id").length.sum().eq(pieces.groupby("doc_id").doc_tokens.first()).all()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_every_document_comes_back(spark, small, name):
    got = Q.QUERIES[name](spark, small)
    source = {"op4_language": "pages", "op6_embedding_dups": "embeddings"}.get(name, "documents")
    key = got.columns[0]
    assert got.select(key).distinct().count() == spark.read.parquet(f"{small}/{source}.parquet").select(key).distinct().count()


def words_of(rng, n):
    return [f"w{rng.randrange(4000)}x{rng.randrange(40)}" for _ in range(n)]


def small_corpus():
    """Copies, near copies, shared lines and passages, junk, short and empty documents."""
    rng = random.Random(11)
    say = lambda n: " ".join(words_of(rng, n))
    line, passage = "This line stands in many of the documents, word for word.", say(70)
    texts = [say(rng.randrange(60, 200)) for _ in range(20)]
    texts += [f"{say(60)}\n{line}\n{say(50)}" for _ in range(7)]
    texts += [f"{say(80)} {passage} {say(60)}" for _ in range(4)]
    base = words_of(rng, 150)
    texts += [" ".join(base), " ".join(base), " ".join(base[:70] + ["other"] + base[71:]), " ".join(base[:20] + ["another"] + base[21:])]
    texts += ["only a few words", "again and again " * 60, "", None, "é日本 " + say(60), say(1500)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def repeats(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_run_as_brute_force(spark, tmp_path):
    rows = small_corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(i, t) for i, t, *_ in rows if len(w := (t or "").split()) >= 10 and 100 * repeats(w) <= 20 * len(w)]  # too few labels to certify a rule
    lined = sorted((i, t) for (i, _, _, t), n in lines(kept, 40, 5).items() for _ in range(n))
    stay = [(i, t) for k, (i, t) in enumerate(lined) if not any(len(a & b) >= 0.8 * len(a | b) for _, o in lined[:k] for a, b in [(shingles(o), shingles(t))])]
    assert len(stay) == len(lined) - 3
    cut = suffixes([t for _, t in stay], C.PASSAGE)
    assert sum(n > 0 for _, n, *_ in cut) == 4
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(left.decode(errors="ignore"), add_special_tokens=False).ids, 0] for (i, _), (*_, left) in zip(stay, cut, strict=True)}
    pieces = C.run(spark, str(tmp_path)).toPandas().sort_values(["doc_id", "start"])
    got = {i: np.frombuffer(b"".join(map(bytes, own.ids)), "<u4").tolist() for i, own in pieces.groupby("doc_id")}
    assert got == want
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
