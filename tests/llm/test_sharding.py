from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import pytest

from textlots.llm import sharding
from textlots.llm.common import settled
from textlots.session import work_dir


def checked(rows, texts, shards=16):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in texts), key=repr
    )
    places, loads = defaultdict(list), [0] * shards
    for row in rows:
        places[row.shard].append(row.place)
        loads[row.shard] += row.size
    for found in places.values():
        assert sorted(found) == list(range(len(found)))
    return loads


def all_of(docs, shards=16):
    sizes = settled(sharding.slot_sizes(docs))
    return sharding.placed(docs, sharding.rebalanced(sizes, shards), sizes).collect()


def test_shards_are_nearly_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loads = checked(all_of(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert max(loads) - min(loads) < 0.01 * max(loads)


def test_edge_cases(edges, edge_rows, no_docs):
    checked(all_of(edges), [(r[0], r[1]) for r in edge_rows])
    assert all_of(no_docs) == []


def test_first_map_deals_the_largest_slot_to_the_lightest_shard(spark):
    sizes = spark.createDataFrame([(s, (s * 7919) % 1009, 1) for s in range(60)], "slot int, bytes long, n_rows long")
    loads, want = [0] * 7, {}
    for size, slot in sorted((-(s * 7919 % 1009), s) for s in range(60)):
        want[slot] = loads.index(min(loads))
        loads[want[slot]] -= size
    got = sharding.rebalanced(sizes, 7).collect()
    assert {r.slot: r.shard for r in got} == want
    assert {r.version for r in got} == {1}


@pytest.mark.parametrize("shards", [6, 8])
def test_versions_move_few_slots(spark, shards):
    sizes = spark.createDataFrame([(s, 100 + s % 13, 1) for s in range(400)], "slot int, bytes long, n_rows long")
    folder = work_dir(spark, "slot-map")
    sharding.store_map(sharding.rebalanced(sizes, 7), folder)
    first = sharding.load_map(spark, folder)
    sharding.store_map(sharding.rebalanced(sizes, shards, first), folder)
    old = {r.slot: r.shard for r in sharding.load_map(spark, folder, 1).collect()}
    newest = sharding.load_map(spark, folder).collect()
    assert {r.version for r in newest} == {2}
    new = {r.slot: r.shard for r in newest}
    assert set(new) == set(old) == set(range(400))
    assert set(new.values()) == set(range(shards))
    moved = [s for s in new if new[s] != old[s]]
    assert len(moved) < 0.2 * 400
    loads = defaultdict(int)
    for slot, shard in new.items():
        loads[shard] += 100 + slot % 13
    assert max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())


def test_documents_keep_their_columns(edges, edge_rows):
    slot_map = sharding.rebalanced(sharding.slot_sizes(edges), 3)
    got = sharding.sharded(edges, slot_map)
    assert got.columns == [*edges.columns, "shard", "virtual_slot"]
    assert got.count() == len(edge_rows)
