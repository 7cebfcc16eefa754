from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlots.llm import language


def held(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identified(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == held(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(right) > 200 and np.mean(right) > 0.97


def test_predictions_use_the_text_alone(some):
    docs, _ = some
    learned = language.learn(docs.select("lang", "text"))
    plain = sorted(tuple(r) for r in language.predicted(docs, learned).collect())
    blind = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None)})
    assert sorted(tuple(r) for r in language.predicted(blind, learned).collect()) == plain


def test_filter_returns_all_languages_of_an_ngram(spark):
    texts = {"aa": "bana  bono", "bb": "bono  buno", **{f"c{i:02d}": "bono" for i in range(70)}}
    docs = spark.createDataFrame(list(texts.items()), "lang string, text string")
    learned = language.learn(docs, min_share=0.0)
    assert learned.langs == sorted(texts)
    shares = learned.shares(["bono", "bana", "zzzz", ""])
    assert (shares[0] > 0.99).all()
    assert shares[1].argmax() == 0 and shares[1][0] > 0.99
    assert (shares[2] < 0.7).all()
    assert (shares[3] == 0).all()


def test_chance_hits_are_taken_off():
    rng = np.random.default_rng(1)
    rows = (rng.random((1 << 12, 1)) < 0.7).astype(np.uint64)
    learned = language.Filter(["aa"], rows)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(5000))
    assert learned.chance[0] == pytest.approx(0.343, abs=0.03)
    assert learned.shares([text])[0, 0] < 0.05


def test_filter_against_exact_sets(spark):
    """Predictions from plain Python sets of common n-grams: the filter only adds chance hits, and takes them off."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]

    def grams(text):
        letters = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in b"  " + text.lower().encode() + b"  ")
        return [g for g in (letters[i : i + 4] for i in range(len(letters) - 3)) if g != b"    "]

    counts = {}
    for doc_id, lang, text in rows:
        if lang is not None and text is not None and not held(doc_id):
            counts.setdefault(lang, Counter()).update(grams(text))
    sets = {
        lang: {g for g, n in own.items() if n >= own.total() * language.MIN_SHARE} for lang, own in counts.items()
    }
    found = {r.doc_id: r for r in language.identified(docs).collect()}
    near = 0
    for doc_id, _, text in rows:
        own = grams(text or "")
        shares = {lang: sum(g in known for g in own) / max(1, len(own)) for lang, known in sets.items()}
        best = min(shares, key=lambda lang: (-shares[lang], lang))
        if not any(c.isalpha() for c in text or ""):
            assert (found[doc_id].lang_pred, found[doc_id].score) == ("und", 0)
            continue
        assert abs(found[doc_id].score - shares[found[doc_id].lang_pred]) < 0.02
        # Another language is named only where its exact share is as good up to chance.
        assert shares[best] - shares[found[doc_id].lang_pred] < 0.02
        near += found[doc_id].lang_pred == best
    assert near >= 0.99 * len(rows)


def test_common_ngrams_only(spark):
    docs = spark.createDataFrame([("aa", "bana " * 999 + "zyxw")], "lang string, text string")
    counts = {r.ngram: r.n for r in language.ngram_counts(docs).collect()}
    codes, _ = language._ngrams(["bana " * 999 + "zyxw"])
    assert counts == Counter(codes.tolist())
    shares = language.learn(docs, min_share=0.01).shares(["bana", "zyxw"])
    assert shares[0, 0] == pytest.approx(0.6) and shares[1, 0] < 0.01


def test_edge_cases(edges, edge_rows, no_docs):
    rows = language.identified(edges).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r[0] for r in edge_rows), key=repr)
    for row in rows:
        texts = [r[1] for r in edge_rows if r[0] == row.doc_id]
        if not any(c.isalpha() for t in texts for c in t or ""):
            assert (row.lang_pred, row.score) == ("und", 0)
    assert language.identified(no_docs).collect() == []
    blank = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identified(blank).collect()} == {"und"}
