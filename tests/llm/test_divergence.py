"""Source divergences against plain dictionaries."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textlots.llm import divergence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def found(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, top=200):
    """Rows (lang, source, text) to all result rows."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        counts[lang, source].update(found(text))
        docs[lang].update(set(found(text)))
    result = []
    for lang in {lang for lang, _ in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        sources = sorted(s for own, s in counts if own == lang)

        def share(count, total):
            return 1 + 10**9 * (count + 1) // (total + len(kept))

        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        p = {s: {t: share(n, sum(of[s].values())) for t, n in of[s].items()} for s in sources}
        whole = {t: sum(of[s][t] for s in sources) for t in kept}
        q = {t: share(n, sum(whole.values())) for t, n in whole.items()}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            high = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", high, top)):
                ranked = sorted(items, key=lambda one: (-one[0], one[1].encode()))[:limit]
                result += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(ranked, 1)]
    return sorted(result)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", "y") for row in rows], "lang string, source string, text string, docs int, term string, counts string").repartition(3)


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


@pytest.mark.parametrize("how", [{}, {"bound": 50, "cell_numbers": 400, "block": 3}, {"top": 2, "cell_numbers": 2000}])
def test_against_brute_force(spark, rows, how):
    assert result(divergence.divergences(frame(spark, rows), **how)) == brute(rows, how.get("top", 200))


def test_edge_cases(spark, edges, edge_rows, no_docs):
    own = [(r[2], r[3], r[1]) for r in edge_rows]
    assert result(divergence.divergences(edges)) == brute(own)
    assert divergence.divergences(no_docs).collect() == []
    odd = [(None, None, "Ähm ähm"), ("", "a", "Ähm b"), ("", "", "ähm B c"), ("en", "s", None), ("en", "t", ""), ("fr", "u", "x y")]
    assert result(divergence.divergences(frame(spark, odd))) == brute(odd)
    same = [("en", "a", "one two"), ("en", "b", "one two")] * 3
    assert result(divergence.divergences(frame(spark, same))) == brute(same)


def word(n):
    return "".join(chr(97 + int(digit)) for digit in str(n))


def test_a_common_term_costs_a_row_per_table_and_source(spark):
    docs = frame(spark, [("en", f"s{i % 2}", f"the the the {word(i)}") for i in range(900)])
    stripes = [r for r in divergence.partial_stripes(docs).collect() if r.term == "the"]
    assert len(stripes) <= 3 and sum(r.docs for r in stripes) == 900
    assert Counter(dict(zip(stripes[0].sources, stripes[0].counts))).total() == 3 * stripes[0].docs
    kept = divergence.stripes(docs).collect()
    assert [(r.lang, r.term, sorted(map(tuple, r.counts))) for r in kept] == [("en", "the", [("s0", 1350), ("s1", 1350)])]


def test_shares_of_large_counts_are_exact():
    counts, total = np.array([0, 5 * 10**12, 8 * 10**15]), 9 * 10**15
    want = [1 + 10**9 * (int(n) + 1) // (total + 77) for n in counts]
    assert divergence.shares(counts, total, 77).tolist() == want
