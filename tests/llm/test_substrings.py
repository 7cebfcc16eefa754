from __future__ import annotations

import random
from hashlib import sha256

import pytest

from textlots.llm import substrings


def expected(rows, window=20):
    order = lambda i: (i is None, i or 0)
    first, split = {}, [((t or "").encode().split(), i) for i, t in rows]
    for words, i in split:
        for start in range(len(words) - window + 1):
            key, place = tuple(words[start : start + window]), (order(i), start)
            first[key] = min(first.get(key, place), place)
    result = []
    for words, i in split:
        gone = set()
        for start in range(len(words) - window + 1):
            if first[tuple(words[start : start + window])] < (order(i), start):
                gone.update(range(start, start + window))
        kept = b" ".join(w for at, w in enumerate(words) if at not in gone)
        result.append((i, len(words), len(gone), sha256(kept).hexdigest()))
    return sorted(result, key=repr)


def found(docs, **how):
    return sorted((tuple(r)[:4] for r in substrings.without_repeats(docs, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"crowded": 2}, {"held_words": 50}, {"crowded": 5, "held_words": 200}])
def test_documents_against_brute_force(some, how):
    docs, rows = some
    want = expected(rows)
    assert sum(r[2] for r in want) > 0
    assert found(docs, **how) == want


def test_few_different_words(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "abcdefg") for _ in range(rng.randrange(90)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for how in ({}, {"crowded": 1, "held_words": 30}):
        assert found(docs, **how) == expected(rows)
    assert found(docs, window=3) == expected(rows, 3)


def test_edge_cases(edges, edge_rows, no_docs):
    assert found(edges) == expected([(r[0], r[1]) for r in edge_rows])
    assert found(no_docs) == []
