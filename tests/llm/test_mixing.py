from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textlots.llm import mixing


def water(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_weight = sum(weight[s] for s in sizes if s not in capped)
        target = {s: capped.get(s, left * weight[s] / max(1, open_weight)) for s in sizes}
        over = [s for s in sizes if s not in capped and target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped |= {s: 3 * sizes[s] for s in over}


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def checked(rows, given):
    """given: (doc_id, text, source)."""
    assert sorted(((r.doc_id, r.size) for r in rows), key=repr) == sorted(((i, n_words(t)) for i, t, _ in given), key=repr)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, text, source in given:
        sizes[source] += n_words(text)
        largest[source] = max(largest[source], n_words(text))
    want = water(sizes)
    for row in rows:
        assert 0 <= row.times <= 3
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(want[row.source])
        taken[row.source] += row.times * row.size
    for source, target in want.items():
        assert abs(taken[source] - target) <= largest[source]


@pytest.mark.parametrize("block", [8, mixing.BLOCK])
def test_sources_reach_their_targets(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.mixture(docs, block=block).collect()
    checked(got, given)
    again = mixing.mixture(docs.repartition(5), block=block).collect()
    assert sorted(got) == sorted(again)


def test_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "JOINED", 2)
    rows = [(i, "w " * (1 + i * i % 97), "one" if i % 3 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    checked(mixing.mixture(docs, block=50).collect(), rows)


def test_edge_cases(edges, edge_rows, no_docs):
    given = [(r[0], r[1], r[3]) for r in edge_rows]
    got = mixing.mixture(edges)
    checked(got.collect(), given)
    assert mixing.mixture(no_docs).collect() == []
    mixed = mixing.mixed(edges)
    assert mixed.columns == edges.columns
    times = defaultdict(int)
    for row in got.collect():
        times[row.doc_id, row.source, row.size] += row.times
    assert Counter((r.doc_id, r.source, n_words(r.text)) for r in mixed.collect()) == +Counter(times)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(4)
    p, sizes = rng.random(500), rng.integers(1, 60, 500).astype(float)
    done = mixing.flight(p, sizes, 9)
    assert ((done > 0) & (done < 1)).sum() <= 2
    assert done.sum() == pytest.approx(p.sum(), abs=1e-5)
    assert (done * sizes).sum() == pytest.approx((p * sizes).sum(), abs=1e-4)


def test_flight_is_unbiased():
    p, sizes = np.array([0.2, 0.5, 0.7, 0.3]), np.array([3.0, 9.0, 4.0, 4.0])
    mean = np.mean([mixing.flight(p, sizes, seed) for seed in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03
