"""The pipeline against its operators' brute-force versions, stage by stage."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import pytest
from test_quality import base
from test_simhash import fingerprint, roots

from textlots.llm import quality
from textlots.llm.common import stored


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.fixture(scope="module")
def steps(spark, small):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], small), name.replace(" ", "-")))
    return frames, [frame.collect() for frame in frames]


def test_columns_stay(steps):
    frames, _ = steps
    assert all(frame.columns == frames[0].columns for frame in frames[:-1])
    assert frames[-1].columns == [*frames[0].columns, "shard", "virtual_slot"]


def test_quality(spark, small, steps):
    frames, rows = steps
    kept = {r.doc_id for r in quality.rated(frames[0], spark.read.parquet(f"{small}/labels.parquet")).collect() if r.kept}
    assert {r.doc_id for r in rows[1]} == kept
    assert not any(base(r.text)[-1] for r in rows[1])
    assert len(rows[1]) > 0.75 * len(rows[0])


def test_near_duplicates(steps):
    _, rows = steps
    prints = {r.doc_id: fingerprint(r.text) for r in rows[1]}
    root = roots(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = defaultdict(list)
    for doc_id, found in prints.items():
        groups[root[found]].append(doc_id)
    assert {r.doc_id for r in rows[2]} == {min(ids) for ids in groups.values()}


def test_decontamination(spark, small, steps):
    _, rows = steps
    windows = set()
    for item in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        words = plain_words(item.text)
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size}

    def clean(text):
        words = plain_words(text)
        return not any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words)))

    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2] if clean(r.text)}


def test_mix_and_shards(steps):
    _, rows = steps
    before = {r.doc_id: r for r in rows[3]}
    times = Counter(r.doc_id for r in rows[4])
    assert set(times) <= set(before) and max(times.values()) <= 3
    total = sum(n_words(r.text) for r in rows[3])
    assert abs(sum(n_words(r.text) for r in rows[4]) - total) < 0.1 * total
    assert Counter(r.doc_id for r in rows[5]) == times
    assert all(0 <= r.shard < 16 and 0 <= r.virtual_slot < 4096 for r in rows[5])
    slots = defaultdict(set)
    for row in rows[5]:
        slots[row.virtual_slot].add(row.shard)
    assert all(len(found) == 1 for found in slots.values())


def test_run_leaves_its_last_stage_alone(spark, small, steps):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    names = [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES]
    before = {name: set(root.glob(f"{name}-*")) for name in names}
    rows = corpus_pipeline.run(spark, small)
    assert Counter(r.doc_id for r in rows.collect()) == Counter(r.doc_id for r in steps[1][-1])
    left = {name: set(root.glob(f"{name}-*")) - before[name] for name in names}
    assert {name: len(found) for name, found in left.items()} == {name: int(name == names[-1]) for name in names}


def test_stages_take_edge_cases(spark, small, edges, no_docs):
    plain = edges.select("doc_id", "text", "lang", "source", "words", "text_hash")
    for docs in (plain, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, small)
            assert found.columns[: len(docs.columns)] == docs.columns
            found.collect()
