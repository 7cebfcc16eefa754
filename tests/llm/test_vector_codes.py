"""Vector codes against plain integer arithmetic over every entry."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pytest

from textlots.llm import vector_codes
from textlots.llm.vector_codes import SlicedBook

SCHEMA = "vec_id long, embedding array<double>, label string, vector string, code int, label_key int"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of rows (vec_id, vector, label), and the listed codebooks."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for vector in cut:
                members.setdefault(nearest(p, vector[p])[1], []).append(vector[p])
            for e, own in members.items():
                books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    found = [[nearest(p, vector[p]) for p in range(parts)] for vector in cut]
    errors = [sum(d for d, _ in one) for one in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    listed = ",".join(str(c) for book in books for entry in book for c in entry)
    return [
        (i, "".join(f"{e:02x}" for _, e in one), error, by_label[label])
        for (i, _, label), one, error in zip(kept, found, errors)
    ], sha256(listed.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, 2) for row in rows], SCHEMA).repartition(3)


def result(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in df.collect()], key=repr)


@pytest.mark.parametrize("n", [5, 90])
def test_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    # Few different values: many ties, and repeated vectors.
    rows = [(i, (rng.integers(-3, 4, 16) / 8).tolist(), None if i % 3 == 0 else f"l{i % 2}") for i in range(n)]
    rows += [(2, rows[2][1], "l0"), (n, rows[3][1], None)]
    want, digest = brute(rows)
    df = vector_codes.vector_codes(frame(spark, rows), hot_rows=4)
    assert result(df) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in df.collect()} == {digest}


def test_edge_cases(spark):
    good = [(i, [float((i * 7 + d) % 5) for d in range(8)], "a") for i in range(4)]
    bad = [(10, None, "a"), (11, [1.0, None] * 4, "a"), (12, [math.nan] * 8, "a"), (13, [math.inf] * 8, "a")]
    odd = [(20, [1.0, 2.0], "a"), (21, [1e300] * 8, "b"), (22, [], "b"), (None, [-0.5] * 8, None)]
    want, digest = brute(good + odd[3:])
    rows = vector_codes.vector_codes(frame(spark, good + bad + odd)).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in rows), key=repr) == sorted(
        [w[:3] for w in want] + [(i, None, None) for i in (20, 21, 22)], key=repr
    )
    assert {r.label_error for r in rows if r.label == "b"} == {None}
    assert {r.codebooks_sha256 for r in rows} == {digest}
    assert vector_codes.vector_codes(frame(spark, good).limit(0)).collect() == []
    assert vector_codes.vector_codes(frame(spark, bad)).collect() == []
    # Seven components cannot be cut into eight parts.
    uncut = vector_codes.vector_codes(frame(spark, [(1, [1.0] * 7, "a")])).collect()
    assert [(r.vec_id, r.code, r.codebooks_sha256) for r in uncut] == [(1, None, sha256(b"").hexdigest())]


@pytest.mark.parametrize("entries", [1, 16, 64, 65, 200])
def test_masks_leave_the_nearest_entry(entries):
    rng = np.random.default_rng(entries)
    book, parts = rng.integers(-50, 50, (entries, 4)), rng.integers(-80, 80, (500, 4))
    distances = ((parts[:, None, :] - book) ** 2).sum(axis=2)
    number, distance = SlicedBook(book).nearest(parts)
    assert (number == distances.argmin(axis=1)).all() and (distance == distances.min(axis=1)).all()
    radius = rng.integers(0, 60, 500)
    masks = SlicedBook(book).candidates(parts, radius)
    inside = (np.abs(parts[:, None, :] - book) <= radius[:, None, None]).all(axis=2)
    bits = np.array([[int(masks[r, e // 64]) >> (e % 64) & 1 for e in range(entries)] for r in range(500)])
    assert (bits == inside).all()


def test_scan_reads_one_column(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    usable = rows.where(vector_codes._finite(rows["embedding"])).select("embedding")
    plan = usable._jdf.queryExecution().executedPlan().toString()
    assert "vec_id" not in plan and "label" not in plan
