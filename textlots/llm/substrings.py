"""Substring dedup: word windows that occur earlier, found through super-k-mers.

Every window of ``WINDOW`` words has a minimiser: its run of ``MINIMISER`` words with the
smallest hash, the first of equals. Consecutive windows that share one form a super-k-mer,
which travels as one packed string to the bucket of that minimiser; equal windows have equal
minimisers and meet there. A bucket sorts its windows by content and place, compares
neighbours word by word, and marks all but the first of each.

Two things keep the traffic down and the buckets small, at every size:

* A window can only repeat if its minimiser does. Minimisers are counted first, in bins of a
  fixed number (``MAX_BINS``); super-k-mers alone in their bin stay where they are.
* Windows of a crowded bin travel one by one, to the bucket of all their words. Equal strings
  of one text slice are reduced to their first before they travel, so a passage that fills
  a third of the corpus arrives once per slice, and a bucket is read as a sorted stream that
  carries on no more than one string per distinct content.

Defined results: null and empty texts have no words; null ids come after all others; windows
of rows with equal ids and starts are at the same place, so neither is earlier; an empty
table gives no rows; texts of any length are read whole, in super-k-mers; other columns of
the input, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from textlots.llm.common import keyed, on_key, slices, text_bytes

WINDOW = 20
MINIMISER = 5
MAX_BINS = 1 << 28
# Bins are grouped into segments of this many, one bit map row each.
SEGMENT = 1 << 16
# Super-k-mers in a bin beyond which its windows travel one by one, besides 8 times the mean.
CROWDED = 10_000
# Words that a bucket's reader holds at a time.
HELD_WORDS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Slice:
    """The super-k-mers of some texts: first and last window of each, and its minimiser's hash."""

    def __init__(self, texts: list[bytes], window: int):
        each = [text.split() for text in texts]
        counts = np.array([len(words) for words in each], dtype=np.int64)
        self.words = [word for words in each for word in words]
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.begin = np.cumsum(counts) - counts
        self.window = window
        size = min(MINIMISER, window)
        n = len(self.words) - window + 1
        if n < 1:
            self.first = self.last = np.zeros(0, dtype=np.int64)
            self.key = np.zeros(0, dtype=np.uint64)
            return
        codes = np.array([crc32(word) for word in self.words], dtype=np.uint64)
        hashes = np.zeros(len(codes) - size + 1, dtype=np.uint64)
        for at in range(size):
            hashes = hashes * _ODD + codes[at : at + len(hashes)] + np.uint64(1)
        hashes = _mix(hashes)
        view = np.lib.stride_tricks.sliding_window_view(hashes, window - size + 1)
        places = np.arange(n) + view[:n].argmin(axis=1)
        inside = np.flatnonzero(self.row[:n] == self.row[window - 1 :])
        places = places[inside]
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (places[1:] != places[:-1]) | (inside[1:] != inside[:-1] + 1)
        heads = np.flatnonzero(new)
        self.first = inside[heads]
        self.last = inside[np.append(heads[1:], len(inside)) - 1] if len(inside) else self.first
        self.key = hashes[places[heads]]

    def packed(self, first: int, last: int) -> bytes:
        return b" ".join(self.words[first : last + self.window])


def _bins_of(keys: np.ndarray, bins: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)


def bin_count(n_bytes: int) -> int:
    """A power of two with several bins per super-k-mer of that much text, up to the fixed limit."""
    return min(MAX_BINS, max(SEGMENT, 1 << max(0, n_bytes // 4 - 1).bit_length()))


def _bin_maps(docs: DataFrame, window: int, bins: int, crowded: int) -> tuple[np.ndarray, np.ndarray]:
    """One bit per bin each: more than one super-k-mer, and more than ``crowded``."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [_Slice(text_bytes(part.column("text")), window).key for part in slices(batch)]
            found = np.sort(_bins_of(np.concatenate([np.zeros(0, dtype=np.uint64), *each]), bins))
            segments, starts = np.unique(found // SEGMENT, return_index=True)
            inside = np.split((found % SEGMENT).astype("<u2"), starts[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(segments, pa.int32()), pa.array([p.tobytes() for p in inside[: len(segments)]], pa.binary())],
                ["segment", "places"],
            )

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = None, np.zeros(SEGMENT, dtype=np.int64)

        def closed() -> pa.RecordBatch:
            bits = [pa.array([np.packbits(counts > limit).tobytes()], pa.binary()) for limit in (1, crowded)]
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), *bits], ["segment", "shared", "crowded"])

        for batch in batches:
            for segment, found in zip(batch.column("segment").to_pylist(), batch.column("places").to_pylist()):
                if segment != held:
                    if held is not None:
                        yield closed()
                    held, counts = segment, np.zeros(SEGMENT, dtype=np.int64)
                counts += np.bincount(np.frombuffer(found, "<u2"), minlength=SEGMENT)
        if held is not None:
            yield closed()

    found = (
        docs.select("text").mapInArrow(places, "segment int, places binary")
        .repartition("segment").sortWithinPartitions("segment")
        .mapInArrow(maps, "segment int, shared binary, crowded binary")
    )
    result = np.zeros((2, bins // 8), dtype=np.uint8)
    # At most MAX_BINS / SEGMENT rows of two bit maps.
    for row in found.toLocalIterator():
        at = slice(row.segment * SEGMENT // 8, (row.segment + 1) * SEGMENT // 8)
        result[0, at] = np.frombuffer(row.shared, np.uint8)
        result[1, at] = np.frombuffer(row.crowded, np.uint8)
    return result[0], result[1]


def _is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1


_ROW = ("key", "packed", "doc_id", "text_hash", "start", "words")


def _travelling(part: pa.RecordBatch, window: int, bins: int, maps) -> list[tuple]:
    """Rows of a slice: strings for the buckets, and spans (no string) that are decided already."""
    shared, crowded = maps
    found = _Slice(text_bytes(part.column("text")), window)
    ids, hashes = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
    places = _bins_of(found.key, bins)
    best: dict[bytes, list] = {}
    rows = []

    def add(first: int, last: int, key: int) -> None:
        row = int(found.row[first])
        start = int(first - found.begin[row])
        order = (ids[row] is None, ids[row] or 0, start)
        packed = found.packed(first, last)
        made = (order, (key - (1 << 64) if key >> 63 else key, packed, ids[row], hashes[row], start, last - first + window))
        held = best.get(packed)
        if held is None or order < held[0][0]:
            best[packed] = [made]
            late = held or ()
        elif order == held[0][0]:
            held.append(made)
            late = ()
        else:
            late = (made,)
        # Later copies of a string in the same slice lose all their words.
        rows.extend((hash(r[3:5]), None, *r[2:]) for _, r in late)

    alone = np.flatnonzero(_is_set(shared, places))
    apart = _is_set(crowded, places)
    for at in alone.tolist():
        first, last = int(found.first[at]), int(found.last[at])
        if apart[at]:
            for only in range(first, last + 1):
                add(only, only, xxh64_intdigest(found.packed(only, only)))
        else:
            add(first, last, int(found.key[at]))
    rows.extend(row for held in best.values() for _, row in held)
    return rows


def _late_windows(strings: list[bytes], rank: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """For each window of the strings, in turn: whether an equal one is earlier in (rank, start)."""
    numbers: dict[bytes, int] = {}
    each = [[numbers.setdefault(word, len(numbers)) for word in packed.split(b" ")] for packed in strings]
    sizes = np.array([len(words) for words in each], dtype=np.int64)
    codes = np.array([number for words in each for number in words], dtype=np.uint64)
    windows = sizes - window + 1
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(begins, windows) + inside
    place = np.repeat(start, windows) + inside
    ranks = np.repeat(rank, windows)
    factor = _ODD
    while True:
        rolling = np.zeros(len(codes) - window + 1, dtype=np.uint64)
        for k in range(window):
            rolling = rolling * factor + _mix(codes[k : k + len(rolling)] + np.uint64(1))
        signs = rolling[at]
        order = np.lexsort((place, ranks, signs))
        same = signs[order[1:]] == signs[order[:-1]]
        pairs = np.flatnonzero(same)
        words = np.arange(window)
        if all(
            (codes[at[order[some]][:, None] + words] == codes[at[order[some + 1]][:, None] + words]).all()
            for some in np.array_split(pairs, 1 + len(pairs) // 100_000)
        ):
            break
        factor = factor * factor + np.uint64(2)  # two contents had one sum: take another factor
    group = np.concatenate([[0], np.cumsum(~same)])
    heads = order[np.flatnonzero(np.concatenate([[True], ~same]))][group]
    late = np.zeros(len(at), dtype=bool)
    late[order] = (ranks[order] != ranks[heads]) | (place[order] != place[heads])
    return late


def _spans(held: list[tuple], n_carried: int, window: int) -> tuple[list[tuple], list[bool]]:
    """Removed spans of a bucket's strings, and which strings hold a first window."""
    order = {key: at for at, key in enumerate(sorted({(r[2] is None, r[2] or 0) for r in held}))}
    rank = np.array([order[(r[2] is None, r[2] or 0)] for r in held], dtype=np.int64)
    start = np.array([r[4] for r in held], dtype=np.int64)
    late = _late_windows([r[1] for r in held], rank, start, window)
    spans, firsts, at = [], [], 0
    for number, row in enumerate(held):
        n = row[5] - window + 1
        own = np.flatnonzero(late[at : at + n])
        at += n
        firsts.append(len(own) < n)
        if number < n_carried or not len(own):
            continue
        breaks = np.flatnonzero(np.diff(own) > window)
        for begin, end in zip(own[np.append(0, breaks + 1)].tolist(), own[np.append(breaks, len(own) - 1)].tolist()):
            spans.append((row[2], row[3], row[4] + begin, row[4] + end + window))
    return spans, firsts


def repeated_spans(docs: DataFrame, window: int = WINDOW, crowded: int = CROWDED, held_words: int = HELD_WORDS) -> DataFrame:
    """(doc_id, text_hash, begin, end): words covered by windows that start earlier elsewhere."""
    rows = keyed(docs)
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = bin_count(n_bytes)
    mean = n_bytes // 40 // bins
    maps = spark.sparkContext.broadcast(_bin_maps(docs, window, bins, crowded + 8 * mean))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.int32() if id_type == "int" else pa.int64()
    types = (pa.int64(), pa.binary(), arrow_id, pa.int64(), pa.int32(), pa.int32())

    def travelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = _travelling(part, window, bins, maps.value)
                columns = zip(*made) if made else ([],) * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(_ROW))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        carried = n_words = 0

        def out(spans: list[tuple]) -> pa.RecordBatch:
            columns = zip(*spans) if spans else ([],) * 4
            kinds = (arrow_id, pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "text_hash", "begin", "end"]
            )

        for batch in batches:
            ready = []
            for row in zip(*(batch.column(name).to_pylist() for name in _ROW)):
                if row[1] is None:
                    ready.append((row[2], row[3], row[4], row[4] + row[5]))
                    continue
                if n_words > held_words:
                    spans, firsts = _spans(held, carried, window)
                    ready += spans
                    # Of a bucket that goes on, strings with a first window stay for comparison.
                    held = [r for r, first in zip(held, firsts) if first and r[0] == row[0]]
                    carried, n_words = len(held), 0
                held.append(row)
                n_words += row[5]
            yield out(ready)
        yield out(_spans(held, carried, window)[0] if held else [])

    strings = rows.mapInArrow(
        travelling,
        f"key bigint, packed binary, doc_id {id_type}, text_hash bigint, start int, words int",
    )
    return (
        strings.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("doc_id"), "start")
        .mapInArrow(decided, f"doc_id {id_type}, text_hash bigint, begin int, end int")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, **how: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): kept is the remaining words, joined by one space."""
    spans = repeated_spans(docs, window, **how).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")
    )
    texts = keyed(docs)
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"),
                     pa.array([squeeze(text) for text in text_bytes(part.column("text"))], pa.binary())],
                    ["doc_id", "text_hash", "text"],
                )

    # Texts meet their spans compressed, which is better than what the shuffle does to rows.
    packed = texts.mapInArrow(squeezed, f"doc_id {id_type}, text_hash bigint, text binary")
    flat = on_key(packed, spans).select(
        "doc_id", "text", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends")
    )

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch):
                made = []
                for text, begins, ends in zip(
                    map(expand, part.column("text").to_pylist()), part.column("begins").to_pylist(), part.column("ends").to_pylist()
                ):
                    words, kept, at = text.split(), [], 0
                    for begin, end in zip(begins or (), ends or ()):
                        kept += words[at:begin]
                        at = max(at, end)
                    kept += words[at:]
                    joined = b" ".join(kept)
                    made.append((len(words), len(words) - len(kept), sha256(joined).hexdigest(), joined.decode()))
                columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
                )

    return flat.mapInArrow(
        cleaned, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    )
