"""License scans against plain search, and what a passage needs to be found."""

from __future__ import annotations

import re

import pytest

from textlots.llm import licenses
from textlots.llm.licenses import BASE, PASSAGES, Passage


def plain(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    words = plain(text)
    found = [
        (start, p.label) for p in BASE for start in range(len(words)) if words[start : start + len(p.words)] == p.words
    ]
    starts = [start for start, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


def brute(texts):
    """Labels and score of each text: every passage at every word."""
    frequency = {}
    for text in texts:
        for word in set(plain(text)):
            frequency[word] = frequency.get(word, 0) + 1
    found = []
    for text in texts:
        words, labels, score = plain(text), set(), 0.0
        for p in PASSAGES:
            needed = licenses.rarest(p, frequency) + p.required()
            for start in range(-len(p.words), len(words)):
                there = {start + i: words[start + i] for i in range(len(p.words)) if 0 <= start + i < len(words)}
                share = sum(there.get(start + i) == word for i, word in enumerate(p.words)) / len(p.words)
                if share >= licenses.MIN_SHARE and all(there.get(start + i) == word for i, word in needed):
                    labels.add(p.label)
                    score = max(score, share)
        found.append((",".join(sorted(labels)), score))
    return found


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_against_brute_force(spark):
    lines = [p.text for p in PASSAGES] + [p.text.title().replace(" ", ", ") for p in PASSAGES]
    cut = [" ".join(p.words[:-1]) for p in PASSAGES] + [" ".join(p.words[1:]) for p in PASSAGES]
    changed = [" ".join("other" if i % 6 == 4 else w for i, w in enumerate(p.words)) for p in PASSAGES]
    noise = ["mit der Lizenz mit dem Wort", "license license license mit license", "under the mit under the mit license"]
    texts = [*lines, *cut, *changed, *noise, " ".join(lines), "the " * 30 + lines[3] + " the" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    wanted = brute(texts)
    for i, text in enumerate(texts):
        assert row(rows[i]) == base(text)
        assert (rows[i].labels, rows[i].score) == wanted[i], text


def test_documents(some):
    docs, texts = some
    rows = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, text in texts:
        assert row(rows[i]) == base(text)
        assert set(filter(None, rows[i].base_labels.split(","))) <= set(rows[i].labels.split(","))


def test_whole_licence_openings_are_found(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
        'documentation files (the "Software"), to deal\nin the Software without restriction',
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
        "the following conditions\nare met:",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under Creative Commons Attribution 4.0 International",
        "Redistribution in binary forms is permitted",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(licenses.license_scan(docs).collect())
    assert [r.labels for r in rows] == ["mit", "bsd", "gpl-3", "cc-by", ""]
    assert [r.score for r in rows][-1] == 0.0


def test_common_words_of_the_corpus_do_not_lead(spark):
    docs = spark.createDataFrame([(i, "mit den mit der") for i in range(50)] + [(99, "under the MIT license")], "doc_id long, text string")
    frequencies = licenses.document_frequencies(docs)
    assert frequencies["mit"] == 51 and frequencies["license"] == 1
    assert licenses.rarest(BASE[0], frequencies)[0][1] == "license"
    assert licenses.rarest(Passage("x", "b a"), {})[0] == (1, "a")


@pytest.mark.parametrize("passage", PASSAGES, ids=lambda p: p.text[:30])
def test_phrases_are_parts_of_their_passage(passage):
    assert passage.words == plain(passage.text)
    assert all(passage.words[i] == word for i, word in passage.required())


def test_edge_cases(edges, edge_rows, no_docs):
    rows = licenses.license_scan(edges).collect()
    got = sorted(((r.doc_id, *row(r), r.labels, r.score) for r in rows), key=repr)
    assert got == sorted(((r[0], *base(r[1]), "", 0.0) for r in edge_rows), key=repr)
    assert licenses.license_scan(no_docs).collect() == []


def test_nothing_runs_in_python(spark, small):
    plan = licenses.license_scan(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
