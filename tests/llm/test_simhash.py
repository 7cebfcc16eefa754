from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from textlots.llm import simhash
from textlots.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def expected(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    root = roots({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for i, p in prints:
        if i is not None:
            least[root[p]].append(i)
    return sorted(((i, p, min(least[root[p]], default=None)) for i, p in prints), key=repr)


def found(docs, **how):
    rows = simhash.near_duplicates(docs, **how).collect()
    return sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in rows), key=repr)


def test_documents_against_brute_force(some):
    docs, rows = some
    assert found(docs) == expected(rows)


def test_edge_cases(edges, edge_rows, no_docs):
    assert found(edges) == expected([(r[0], r[1]) for r in edge_rows])
    assert found(no_docs) == []


def test_every_pair_within_two_bits_shares_a_key():
    rng = random.Random(5)
    keys = simhash._decoder()
    for _ in range(300):
        word = rng.getrandbits(23)
        other = word ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23))
        both = keys(np.array([word, other]))
        assert len(set(both[0])) in (1, 6)
        assert set(both[0]) & set(both[1])


def test_crowded_buckets_and_pairs_link_the_same(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(12):
        near = rng.getrandbits(64)
        for _ in range(60):
            prints.add(near)
            near ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                near ^= 1 << rng.randrange(64)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = roots({p for (p,) in signed}, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    frame = spark.createDataFrame(signed, "fingerprint long")
    for bucket in (0, 3, 1000):
        got = {r.node: r.root for r in components(simhash.links(frame, bucket)).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_one_row_stays_in_each_component(edges, edge_rows):
    kept = simhash.representatives(edges).collect()
    assert edges.columns == list(kept[0].asDict())
    assert len(kept) == len(set(roots({fingerprint(r[1]) for r in edge_rows}, lambda a, b: (a ^ b).bit_count() <= 2).values()))
    assert {r.doc_id for r in kept} == {c for _, _, c in expected([(r[0], r[1]) for r in edge_rows])}


def test_slices_cover_a_batch():
    from textlots.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 0, 50, 2, 2)] + [None]}).slice(1)
    parts = list(slices(batch, max_bytes=4))
    assert [v for p in parts for v in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert [p.num_rows for p in parts] == [1, 1, 3]
