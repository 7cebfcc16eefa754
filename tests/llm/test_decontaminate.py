from __future__ import annotations

import re
from collections import defaultdict

from textlots.llm import decontaminate


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(rows, items, window=10):
    owners = defaultdict(set)
    for item_id, text in items:
        found = words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            owners[tuple(found[i : i + size])].add(item_id)
    result = []
    for doc_id, text in rows:
        found, hit, by = words(text), set(), set()
        for size in {len(w) for w in owners}:
            for i in range(len(found) - size + 1):
                if tuple(found[i : i + size]) in owners:
                    hit.update(range(i, i + size))
                    by |= owners[tuple(found[i : i + size])]
        result.append((doc_id, len(found), len(hit), tuple(sorted(str(i) for i in by if i is not None))))
    return sorted(result, key=repr)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far"), (2, "brown FOX"), (3, "lazy"), (4, None), (5, "!!"),
    (None, "one"), (2, "emoji 😀 end"), (11, "two"), (7, "the quick brown fox jumps over the lazy dog and RUNS FAR"),
]


def found(docs, benchmark):
    rows = decontaminate.contamination(docs, benchmark).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=repr)


def test_edge_cases(spark, edges, edge_rows, no_docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = expected([(r[0], r[1]) for r in edge_rows], ITEMS)
    assert found(edges, benchmark) == want
    assert found(no_docs, benchmark) == []
    assert {r[2:] for r in found(edges, benchmark.limit(0))} == {(0, ())}
    kept = decontaminate.without_documents(edges, benchmark)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in want if not r[2]), key=repr)


def test_blocks_of_windows_find_the_same(spark, some):
    docs, _ = some
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    windows = decontaminate.benchmark_windows(benchmark)
    hits = {tuple(r[:4]) for r in decontaminate.window_hits(docs, windows).collect()}
    assert hits and {tuple(r[:4]) for r in decontaminate.window_hits(docs, windows, block_windows=700).collect()} == hits


def test_spans_are_cut_out(spark):
    rows = [(1, "Well, a  brown fox, LAZY or not!"), (2, "clean text"), (3, None), (4, "lazy")]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.without_spans(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {1: "Well, a   ,  or not!", 2: "clean text", 3: None, 4: ""}
