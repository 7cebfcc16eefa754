"""Vector code compression: a codebook per part of the vector, trained in rounds.

Vectors become integers, are cut into equal parts, and each part is replaced by the number
of its nearest codebook entry. The nearest entry is found by slices and masks: the entries'
coordinates are sorted in each dimension, and every sorted prefix carries a mask of the
entries in it. The distance to one guessed entry is the initial radius around the part. It
selects a range of the sorted coordinates per dimension; two prefix masks tell which entries
stand in it. All dimensions' masks ANDed leave the entries inside the box of that radius:
every entry as near as the guess is among them, and they alone are measured.

A round is one pass over the vectors: tasks add up their parts per entry, Spark adds up the
tasks, and the driver reads one row per part, entry and dimension (a few thousand numbers,
whatever the number of vectors). Nothing else leaves the executors.

Defined results: rows whose vector is null, or holds null or non-finite components, are
left out. Vectors of another length than that of the smallest id's, of a length that cannot
be cut, or with components so large that a distance would not fit into 64 bits keep their
row without code and error. Equal ids keep a row each; where they are among the first
entries the smaller vector comes first. Null ids come last. Fewer vectors than entries give
fewer entries; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlots.llm.common import id_text, stored
from textlots.operators.joins import HOT_ROWS, lookup_join

PARTS = 8
# At most 256: an entry's number takes two hexadecimal digits.
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
WORD_BITS = 64


class SlicedBook:
    """The entries of one part's codebook, ready for the search by masks."""

    def __init__(self, entries: np.ndarray):
        n, width = entries.shape
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.slices = np.take_along_axis(entries, self.order, axis=0)
        number = np.arange(n)
        bits = np.zeros((n, -(-n // WORD_BITS)), dtype=np.uint64)
        bits[number, number // WORD_BITS] = np.uint64(1) << (number % WORD_BITS).astype(np.uint64)
        self.prefixes = np.zeros((width, n + 1, bits.shape[1]), dtype=np.uint64)
        for dim in range(width):
            self.prefixes[dim, 1:] = np.bitwise_or.accumulate(bits[self.order[:, dim]], axis=0)
        self.widest = int(np.argmax(self.slices[-1] - self.slices[0]))

    def _guess(self, parts: np.ndarray) -> np.ndarray:
        """An entry near each part in the dimension where the entries differ most."""
        at = np.searchsorted(self.slices[:, self.widest], parts[:, self.widest])
        return self.order[np.minimum(at, len(self.entries) - 1), self.widest]

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A mask per part of the entries within its radius in every dimension."""
        masks = np.full((len(parts), self.prefixes.shape[2]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for dim, prefix in enumerate(self.prefixes):
            first = np.searchsorted(self.slices[:, dim], parts[:, dim] - radius, "left")
            last = np.searchsorted(self.slices[:, dim], parts[:, dim] + radius, "right")
            masks &= prefix[last] ^ prefix[first]
        return masks

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each part's nearest entry, the lower number on ties."""
        number = self._guess(parts)
        distance = ((parts - self.entries[number]) ** 2).sum(axis=1)
        # One more than the root's floor: never less than the root, whatever its rounding.
        masks = self.candidates(parts, np.sqrt(distance).astype(np.int64) + 1)
        for entry, place in enumerate(self.entries):
            bit = masks[:, entry // WORD_BITS] >> np.uint64(entry % WORD_BITS) & np.uint64(1)
            rows = np.flatnonzero(bit)
            found = ((parts[rows] - place) ** 2).sum(axis=1)
            nearer = (found < distance[rows]) | ((found == distance[rows]) & (entry < number[rows]))
            distance[rows[nearer]] = found[nearer]
            number[rows[nearer]] = entry
        return number, distance


def _largest(dim: int) -> int:
    """Components up to this size keep the sum of ``dim`` squared differences below 2 ** 62."""
    return isqrt((1 << 62) // max(dim, 1)) // 2


def _finite(vec: Column) -> Column:
    return F.coalesce(F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def _usable(vec: Column, dim: int, parts: int) -> Column:
    if not dim or dim % parts:
        return F.lit(False)
    limit = _largest(dim) / SCALE
    return (F.size(vec) == dim) & F.forall(vec, lambda x: F.abs(x) < F.lit(limit))


def _integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(4096 x) of the components, a row per vector that is not null."""
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dim)


def _first_vectors(kept: DataFrame, vec: str, n: int) -> list[list[float]]:
    rows = kept.select("vec_id", vec).orderBy(F.asc_nulls_last("vec_id"), vec).limit(n).collect()
    return [row[vec] for row in rows]


def _sums(vectors: DataFrame, books: list[SlicedBook], dim: int) -> DataFrame:
    """(part, entry, position, n, total) of all vectors."""
    width = dim // len(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(books), len(books[0].entries)), dtype=np.int64)
        totals = np.zeros((*n.shape, width), dtype=np.int64)
        for batch in batches:
            matrix = _integers(batch.column(0), dim)
            for part, book in enumerate(books):
                values = matrix[:, part * width : (part + 1) * width]
                numbers, _ = book.nearest(values)
                n[part] += np.bincount(numbers, minlength=n.shape[1])
                for entry in np.unique(numbers):
                    totals[part, entry] += values[numbers == entry].sum(axis=0)
        part, entry, position = (place.ravel() for place in np.indices(totals.shape))
        used = n[part, entry] > 0
        columns = (part, entry, position, n[part, entry], totals.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column[used].astype(np.int64)) for column in columns], ["part", "entry", "position", "n", "total"]
        )

    sums = vectors.mapInArrow(work, "part bigint, entry bigint, position bigint, n bigint, total bigint")
    return sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def trained(vectors: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position) after some rounds over a one-column table of vectors."""
    dim = first.shape[1]
    books = np.stack(np.split(first, parts, axis=1))
    for _ in range(rounds):
        sums = _sums(vectors, [SlicedBook(book) for book in books], dim).collect()
        for row in sums:
            books[row.part, row.entry, row.position] = row.total // row.n
    return books


def _coded(kept: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """vec_id, label, code and error of all kept rows; the vector column is null where it has no code."""
    sliced = [SlicedBook(book) for book in books]
    width = dim // len(sliced) if sliced else 0
    schema = T.StructType(
        [*kept.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("vector").is_valid().to_numpy(zero_copy_only=False)
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            rows = np.flatnonzero(coded)
            if len(rows):
                matrix = _integers(batch.column("vector"), dim)
                numbers = np.zeros((len(rows), len(sliced)), dtype=np.uint8)
                error = np.zeros(len(rows), dtype=np.int64)
                for part, book in enumerate(sliced):
                    numbers[:, part], distance = book.nearest(matrix[:, part * width : (part + 1) * width])
                    error += distance
                for row, number, found in zip(rows.tolist(), numbers, error.tolist()):
                    codes[row], errors[row] = number.tobytes().hex(), found
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                schema.names,
            )

    return kept.mapInArrow(work, schema)


def codebooks(
    rows: DataFrame, vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[int, np.ndarray]:
    """Length of the vectors, and the trained codebooks (part, entry, position)."""
    kept = rows.where(_finite(F.col(vec)))
    first = _first_vectors(kept, vec, entries)
    dim = len(first[0]) if first else 0
    if not dim or dim % parts:
        return dim, np.zeros((0, 0, 0), dtype=np.int64)
    usable = kept.where(_usable(F.col(vec), dim, parts))
    limit = _largest(dim) / SCALE
    if any(len(v) != dim or max(map(abs, v)) >= limit for v in first):
        first = _first_vectors(usable, vec, entries)
    if not first:
        return dim, np.zeros((0, 0, 0), dtype=np.int64)
    start = _integers(pa.array(first, pa.list_(pa.float64())), dim)
    return dim, trained(usable.select(vec), start, parts, rounds)


def listed(books: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def vector_codes(
    rows: DataFrame, vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row with a finite vector.

    ``rows`` has the columns vec_id, label and ``vec``; it is read once per round.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code takes two hexadecimal digits: 1 to 256 entries")
    dim, books = codebooks(rows, vec, parts, entries, rounds)
    able = _usable(F.col(vec), dim, parts) if books.size else F.lit(False)
    kept = rows.where(_finite(F.col(vec))).select("vec_id", "label", F.when(able, F.col(vec)).alias("vector"))
    coded = stored(_coded(kept, books, dim), "vector-codes").withColumn("label_key", id_text(F.col("label")))
    sums = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    # A value per row that no label has.
    apart = F.concat(F.lit("!"), F.xxhash64("vec_id", "code").cast("string"))
    summed = lookup_join(coded, sums, ["label_key"], ["label_error"], "n", apart, hot_rows)
    digest = sha256(listed(books).encode()).hexdigest()
    return summed.drop("label_key").withColumn("codebooks_sha256", F.lit(digest))
