"""SimHash near duplicates, linked through fuzzy Golay keys.

Fingerprints of 64 bits are cut into three segments of at most 23 bits. The perfect
(23, 12) Golay code decodes every 23-bit word to the one codeword within three bits; the
codewords of a segment and of its 23 one-bit neighbours are its fuzzy keys, at most six.
Two segments within two bits of each other share a neighbour, hence a key. If two
fingerprints differ in at most two of 64 bits, one of three segments is equal (pigeonhole)
and the next one is within two bits: an exact segment plus a fuzzy key of its successor
finds every such pair, which is then verified.

Buckets of more than ``BUCKET`` fingerprints are not compared pair by pair. Their
fingerprints take an equally exact route: each sends itself and its 64 one-bit neighbours
as group keys; members of one group are at most two bits apart and two fingerprints that
close share a group, so linking each group to its smallest member loses no link.

Defined results: null and empty texts have the all-zero fingerprint and are linked like
any other; a null id never names a component unless all ids of the component are null;
texts of any length are read whole; rows equal in id and text keep a row each; an empty
table gives an empty result; other columns of the input, whatever their names, are left
behind, or pass through ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlots.llm.common import keyed, one_row_each, settled, slices, stored, text_bytes
from textlots.llm.components import components

SHINGLE = 3
BITS = 64
MAX_DIFFERENCE = 2
BUCKET = 32

# Bits of the fingerprint in each segment: 22 + 21 + 21.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(part) for part in zip(*(words[i:] for i in range(size)))]


def _fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    """Majority bits of the shingle hashes of each text, as signed 64-bit numbers."""
    from xxhash import xxh64_intdigest

    hashes, counts = [], []
    for text in texts:
        found = _shingles(text, size)
        counts.append(len(found))
        hashes.extend([xxh64_intdigest(shingle, 42) for shingle in found])
    counts = np.array(counts, dtype=np.int64)
    result = np.zeros(len(texts), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        starts = np.cumsum(counts) - counts
        values = np.array(hashes, dtype=np.uint64)
        for bit in range(BITS):
            ones = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(1), starts[filled])
            result[filled] |= (ones * np.uint64(2) > counts[filled].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return result.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of every document."""
    rows = keyed(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = _fingerprints(text_bytes(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(prints)],
                    ["doc_id", "text_hash", "fingerprint"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, text_hash bigint, fingerprint bigint")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _error_table() -> np.ndarray:
    """The error of at most three bits that each of the 2,048 syndromes stands for."""
    errors = np.array(
        [sum(1 << bit for bit in bits) for n in range(4) for bits in combinations(range(23), n)], dtype=np.int64
    )
    table = np.zeros(1 << 11, dtype=np.int64)
    table[_syndromes(errors)] = errors
    return table


def _decoder():
    errors = _error_table()
    flips = np.array([0, *(1 << bit for bit in range(23))], dtype=np.int64)
    # Remainders are linear, so a neighbour's is the word's own combined with the flip's.
    flip_syndromes = _syndromes(flips)

    def fuzzy_keys(words: np.ndarray) -> np.ndarray:
        """Codeword index of each word and of its one-bit neighbours: an array of 24 columns."""
        syndromes = _syndromes(words)[:, None] ^ flip_syndromes
        codewords = words[:, None] ^ flips ^ errors[syndromes]
        return codewords >> 11

    return fuzzy_keys


def golay_keys(prints: DataFrame) -> DataFrame:
    """(key, fingerprint): 3 to 18 bucket keys of each distinct fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy_keys = _decoder()
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [
                ((values >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
                for first, width in SEGMENTS
            ]
            for at, exact in enumerate(parts):
                fuzzy = np.sort(fuzzy_keys(parts[(at + 1) % len(parts)]), axis=1)
                fresh = np.ones(fuzzy.shape, dtype=bool)
                fresh[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
                row, column = np.nonzero(fresh)
                keys = (np.int64(at) << 40) | (exact[row] << 12) | fuzzy[row, column]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(values[row].view(np.int64))], ["key", "fingerprint"]
                )

    return prints.select("fingerprint").mapInArrow(work, "key bigint, fingerprint bigint")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) pairs, src > dst, that connect all fingerprints within two bits of each other.

    ``prints`` holds distinct fingerprints. Of a crowded bucket's links only those to the
    smallest member of each neighbour group are given; they connect the same fingerprints.
    """
    keys = settled(golay_keys(prints))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"))
    shared = settled(
        keys.join(sizes.where("n > 1"), "key").select("key", "fingerprint", (F.col("n") > bucket).alias("crowded"))
    )
    few = shared.where("NOT crowded")
    near = (
        few.select("key", F.col("fingerprint").alias("src"))
        .join(few.select("key", F.col("fingerprint").alias("dst")), "key")
        .where((F.col("src") > F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_DIFFERENCE))
        .select("src", "dst")
    )
    many = shared.where("crowded").select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(BITS)])
    balls = many.select("fingerprint", F.explode(flips).alias("flip")).select(
        F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("centre"), "fingerprint"
    )
    # A group has at most 65 members, since each differs from the centre in one bit at most.
    stars = balls.groupBy("centre").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1)
    spokes = (
        stars.select(F.array_min("members").alias("dst"), F.explode("members").alias("src"))
        .where(F.col("src") > F.col("dst"))
        .select("src", "dst")
    )
    return near.unionAll(spokes).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, root) of every document.

    ``component_id`` is the smallest id that chains of links reach, the row's own included;
    ``root`` is the smallest fingerprint of the component.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    prints = settled(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(prints, bucket))
    labelled = (
        prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .withColumn("root", F.coalesce("root", "fingerprint"))
    )
    firsts = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(firsts, "root").select("fingerprint", "component_id", "root")
    return rows.join(named, "fingerprint", "left").select("doc_id", "text_hash", "fingerprint", "component_id", "root")


def representatives(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """The documents, all columns, of which one stays in each component: its smallest id.

    Of rows with that same id in one component the one with the smallest text hash stays; of
    rows equal in both, one. Null ids come last.
    """
    return one_of_each(docs, near_duplicates(docs, shingle, bucket), "fingerprint")


def one_of_each(docs: DataFrame, rows: DataFrame, *finer: str) -> DataFrame:
    """The documents that stay of the components (``root``) of ``rows``, by smallest id and text hash."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("best")
    # One row per fingerprint first, so that a crowded component shuffles few rows.
    kept = rows.groupBy("root", *finer).agg(best).groupBy("root").agg(F.min("best").alias("best"))
    return one_row_each(docs, settled(kept.select("best.doc_id", "best.text_hash")))
