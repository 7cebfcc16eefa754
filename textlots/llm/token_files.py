"""Token-id files with constant-time access by document key.

A file set is a Parquet table of segments in ascending key order. A segment holds the raw
ids of consecutive documents (little-endian unsigned 32-bit numbers, an end id after each
document) and an index: a minimal perfect hash sends each document key to a slot of its own,
and the slot stores a fingerprint of the key, where its ids start and how many they are.
A reader hashes the key it wants, takes the slot, compares the fingerprint and cuts the ids.

The hash is of the hash-and-displace kind: keys fall into buckets of about four; each
bucket, the largest first, tries pilots until all its keys land in free slots; the only key
of a bucket takes a free slot directly, so that no slot stays empty.

Spark writes and commits the files, so a lost executor leaves no half segment behind.

Defined results: a null or empty text is the end id alone; null ids sort first; rows that
repeat an id are told apart by their place among them (the smaller text hash first); a text
of any length is one document, which may exceed a segment's usual size; an empty table gives
files without segments; other columns of the input are left behind.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlots.llm import pretokens
from textlots.llm.common import keyed, settled, slices

END_ID = 0
# A segment ends after this many ids or documents; one long document may exceed the former.
SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 15
# Distinct parts whose ids a worker process remembers, in each of two generations.
REMEMBERED = 400_000

BUCKET_KEYS = 4
EMPTY_KEY = -1

SEGMENT = """shard int, segment int, n_docs int, n_ids bigint, first_id bigint, last_id bigint,
    doc_ids array<bigint>, ids binary, pilots binary, fingerprints binary, starts binary, lengths binary"""


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(doc_ids: list[int | None]) -> np.ndarray:
    """One hash per document of a segment, from its id and its place among equal ids."""
    known = np.array([0 if i is None else i for i in doc_ids], dtype=np.int64).view(np.uint64)
    absent = np.array([i is None for i in doc_ids], dtype=np.uint64)
    place = np.zeros(len(doc_ids), dtype=np.uint64)
    for row in range(1, len(doc_ids)):
        if doc_ids[row] == doc_ids[row - 1]:
            place[row] = place[row - 1] + np.uint64(1)
    return _hashes(known, absent, place)


def _hashes(known: np.ndarray, absent: np.ndarray, place: np.ndarray) -> np.ndarray:
    return _mix(_mix(known) + _mix(place * np.uint64(2) + absent + np.uint64(0x9E3779B97F4A7C15)))


def _slots(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (_mix(hashes ^ _mix(pilots.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(-(-n // BUCKET_KEYS))).astype(np.int64)


def build_index(hashes: np.ndarray) -> np.ndarray:
    """A pilot per bucket; a negative one is the complement of a lone key's slot."""
    n = len(hashes)
    buckets = _buckets(hashes, n)
    order = np.argsort(buckets, kind="stable")
    n_buckets = -(-n // BUCKET_KEYS)
    ends = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    sizes = np.diff(ends)
    pilots = np.zeros(n_buckets, dtype=np.int32)
    free = np.ones(n, dtype=bool)
    tries = np.arange(256, dtype=np.uint64)
    for bucket in np.argsort(-sizes, kind="stable"):
        size = sizes[bucket]
        if size < 2:
            break
        own = hashes[order[ends[bucket] : ends[bucket + 1]]]
        first = np.uint64(0)
        while True:
            seeds = _mix(tries + first)
            places = (_mix(own[None, :] ^ seeds[:, None]) % np.uint64(n)).astype(np.int64)
            spread = np.sort(places, axis=1)
            fits = free[places].all(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1)
            if fits.any():
                break
            first += np.uint64(len(tries))
            if first >= 1 << 31:
                raise ValueError("two keys of a segment have the same hash")
        found = int(np.argmax(fits))
        pilots[bucket] = int(first) + found
        free[places[found]] = False
    lone = np.flatnonzero(sizes == 1)
    pilots[lone] = ~np.flatnonzero(free)[: len(lone)]
    return pilots


def find_slots(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key hash, in constant time per key."""
    pilot = pilots[_buckets(hashes, n)]
    return np.where(pilot < 0, ~pilot.astype(np.int64), _slots(hashes, np.maximum(pilot, 0), n))


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The whole hash, which for documents of the same place among equal ids is one to one."""
    return hashes.astype("<u8")


def _segment(shard: int, number: int, doc_ids: list, payloads: list[bytes]) -> dict:
    hashes = key_hashes(doc_ids)
    pilots = build_index(hashes)
    slots = find_slots(hashes, pilots, len(doc_ids))
    sizes = np.array([len(payload) // 4 for payload in payloads], dtype=np.int64)
    fingerprints = np.zeros(len(doc_ids), dtype="<u8")
    starts, lengths = np.zeros((2, len(doc_ids)), dtype="<i8")
    fingerprints[slots] = _fingerprint(hashes)
    starts[slots] = np.cumsum(sizes) - sizes
    lengths[slots] = sizes
    known = [i for i in doc_ids if i is not None]
    return {
        "shard": shard, "segment": number, "n_docs": len(doc_ids), "n_ids": int(sizes.sum()),
        "first_id": min(known, default=None), "last_id": max(known, default=None), "doc_ids": doc_ids,
        "ids": b"".join(payloads), "pilots": pilots.astype("<i4").tobytes(),
        "fingerprints": fingerprints.tobytes(), "starts": starts.tobytes(), "lengths": lengths.tobytes(),
    }


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode every document and write the segments below ``path``, in ascending id order."""
    ordered = (
        keyed(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
        .repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_segment(shard, number, doc_ids, payloads)], schema)

        number, size, doc_ids, payloads = 0, 0, [], []
        for batch in batches:
            for part in slices(batch):
                ids = pretokens.payloads(tokenizer_path, REMEMBERED).__getitem__
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    payload = b"".join([*map(ids, pretokens.cut(text or "")), end])
                    doc_ids.append(doc_id)
                    payloads.append(payload)
                    size += len(payload) // 4
                    if size >= SEGMENT_IDS or len(doc_ids) >= SEGMENT_DOCS:
                        yield closed()
                        number, size, doc_ids, payloads = number + 1, 0, [], []
        if doc_ids:
            yield closed()

    schema = pa.schema([
        ("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
        ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        *[(name, pa.binary()) for name in ("ids", "pilots", "fingerprints", "starts", "lengths")],
    ])
    # Small row groups, so that a reader takes a few segments at a time.
    ordered.mapInArrow(work, SEGMENT).write.option("parquet.block.size", str(32 << 20)).parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


def _found(segment: dict, rows: np.ndarray) -> list[tuple[int, memoryview]]:
    """(start in the segment, ids) of some documents of a segment, through its index."""
    hashes = key_hashes(segment["doc_ids"])[rows]
    slots = find_slots(hashes, np.frombuffer(segment["pilots"], "<i4"), segment["n_docs"])
    if (np.frombuffer(segment["fingerprints"], "<u8")[slots] != _fingerprint(hashes)).any():
        raise ValueError(f"segment {segment['shard']}/{segment['segment']} does not hold all its keys")
    starts = np.frombuffer(segment["starts"], "<i8")[slots].tolist()
    lengths = np.frombuffer(segment["lengths"], "<i8")[slots].tolist()
    payload = memoryview(segment["ids"])
    return [(start, payload[4 * start : 4 * (start + n)]) for start, n in zip(starts, lengths)]


def _segments(batch: pa.RecordBatch) -> Iterator[dict]:
    for row in range(batch.num_rows):
        yield batch.slice(row, 1).to_pylist()[0]


def documents_of(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts all ids before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in _segments(batch):
                found = _found(segment, np.arange(segment["n_docs"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment["shard"]] * len(found), pa.int32()),
                        pa.array([segment["segment"]] * len(found), pa.int32()),
                        pa.array(segment["doc_ids"], pa.int64()),
                        pa.array([start for start, _ in found], pa.int64()),
                        pa.array([len(ids) // 4 for _, ids in found], pa.int64()),
                        pa.array([crc32(ids) for _, ids in found], pa.int64()),
                    ],
                    ["shard", "segment", "doc_id", "own_start", "n_tokens", "ids_crc32"],
                )

    rows = segments.mapInArrow(
        work, "shard int, segment int, doc_id bigint, own_start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return (
        rows.join(_bases(segments), ["shard", "segment"])
        .select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def _bases(segments: DataFrame) -> DataFrame:
    """(shard, segment, base): ids in all segments before; only one row per shard meets in one task."""
    sizes = segments.select("shard", "segment", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return settled(
        own.join(shards, "shard").select("shard", "segment", (F.col("own") + F.col("shard_base")).alias("base"))
    )


def _looked_up(segment: dict, wanted: list[int]) -> Iterator[tuple[int, int, int]]:
    """(doc_id, start, ids) of the wanted documents that a segment holds: hash, slot, fingerprint."""
    pilots = np.frombuffer(segment["pilots"], "<i4")
    prints = np.frombuffer(segment["fingerprints"], "<u8")
    starts, lengths = (np.frombuffer(segment[name], "<i8") for name in ("starts", "lengths"))
    known, place = np.array(wanted, dtype=np.int64), 0
    while len(known):
        # Documents that repeat an id have the places 0, 1, ... under it.
        hashes = _hashes(known.view(np.uint64), np.zeros(len(known), np.uint64), np.full(len(known), place, np.uint64))
        slots = find_slots(hashes, pilots, segment["n_docs"])
        there = prints[slots] == _fingerprint(hashes)
        known, slots, place = known[there], slots[there], place + 1
        yield from zip(known.tolist(), starts[slots].tolist(), lengths[slots].tolist())


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a stated list of documents, each found in constant time through the indexes.

    Only the indexes of segments whose range holds a wanted id are read; then the ids of the
    shards in which one was found. The lists of document ids are not looked at.
    """
    wanted = sorted(set(doc_ids))
    inside = (F.col("last_id") >= min(wanted, default=0)) & (F.col("first_id") <= max(wanted, default=-1))
    segments = read_segments(spark, path).where(inside)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in _segments(batch):
                first = bisect_left(wanted, segment["first_id"])
                own = wanted[first : bisect_right(wanted, segment["last_id"])]
                rows = [(segment["shard"], segment["segment"], *row) for row in _looked_up(segment, own)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(hit.names, row)) for row in rows], hit)

    hit = pa.schema(
        [("shard", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]
    )
    index = segments.drop("doc_ids", "ids")
    hits = settled(index.mapInArrow(work, "shard int, segment int, doc_id bigint, start bigint, n bigint"))
    # No more than one row per wanted document comes back, and no more shards than that.
    shards = [row.shard for row in hits.select("shard").distinct().collect()]
    payloads = segments.where(F.col("shard").isin(shards)).select("shard", "segment", "ids")
    cut = payloads.join(hits, ["shard", "segment"]).select(
        "doc_id", F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("n")).cast("int")).alias("ids")
    )

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(ids, "<u4").astype(np.int64) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "ids"]
            )

    return cut.mapInArrow(decoded, "doc_id bigint, ids array<bigint>")
