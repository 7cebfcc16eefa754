"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of bits per position and one column per language.
The common n-grams of a language (four bytes of lower-cased text, all but letters read as
spaces) set its bit in a few rows. The rows of an n-gram, combined with AND, name all
languages that contain it. A document's n-grams are looked up, counted per language, and
corrected for the share that each column returns by chance; the largest share decides.

An n-gram is common if it makes up ``MIN_SHARE`` of its language's n-grams or more, so a
column holds 1 / ``MIN_SHARE`` n-grams at most, whatever the corpus. Every learning row is
counted.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is
everything if nothing was learned; of equal languages the first by code point wins; a null
id is hashed like an empty one; repeated rows count as often as they occur; texts
of any length are read whole; other columns of the input, whatever their names, are left
behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlots.llm.common import settled, slices

NGRAM = 4
MIN_SHARE = 1e-5
POSITIONS = 1 << 21
HASHES = 3
FOLDS, HELD_FOLD = 3, 1
UNKNOWN = "und"
# Distinct (language, n-gram) pairs that a task gathers before it hands them on.
GATHERED = 2_000_000

# Bytes that stay: ASCII letters and all of other scripts.
_LETTERS = np.array([b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of some texts, and the text of each."""
    padded = [b"  " + text.lower().encode() + b"  " for text in texts]
    lengths = np.array([len(text) for text in padded], dtype=np.int64)
    letters = _LETTERS[np.frombuffer(b"".join(padded), dtype=np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    n = len(letters) - NGRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    codes = np.zeros(n, dtype=np.uint32)
    for at in range(NGRAM):
        codes = (codes << np.uint32(8)) | letters[at : at + n]
    real = (row[:n] == row[NGRAM - 1 :]) & (codes != 0x20202020)
    return codes[real], row[:n][real]


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, ngram, n) over rows of (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def gathered() -> pa.RecordBatch:
            listed = pa.array(list(names), pa.string())
            return pa.RecordBatch.from_arrays(
                [
                    listed.take(pa.array((held >> np.uint64(32)).astype(np.int64))),
                    pa.array((held & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts),
                ],
                ["lang", "ngram", "n"],
            )

        for batch in batches:
            for part in slices(batch):
                codes, row = _ngrams([text or "" for text in part.column("text").to_pylist()])
                lang = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()], dtype=np.uint64)
                found, n = np.unique((lang[row] << np.uint64(32)) | codes, return_counts=True)
                every = np.concatenate([held, found])
                held, place = np.unique(every, return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), minlength=len(held)).astype(np.int64)
                if len(held) > GATHERED:
                    yield gathered()
                    held, counts = held[:0], counts[:0]
        yield gathered()

    return (
        docs.select("lang", "text").mapInArrow(work, "lang string, ngram bigint, n bigint")
        .groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    )


def _positions(ngrams: np.ndarray, positions: int) -> list[np.ndarray]:
    x = ngrams.astype(np.uint64)
    result = []
    for _ in range(HASHES):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        result.append((x % np.uint64(positions)).astype(np.int64))
    return result


class Filter:
    """The rows of bits, 64 languages to a word, and what each language returns by chance."""

    def __init__(self, langs: list[str], rows: np.ndarray):
        self.langs, self.rows = langs, rows
        fill = np.array([self._bit(rows, at).mean() for at in range(len(langs))])
        self.chance = fill**HASHES

    @staticmethod
    def _bit(masks: np.ndarray, at: int) -> np.ndarray:
        return (masks[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Share of each text's n-grams that each language contains, chance hits taken off."""
        codes, row = _ngrams(texts)
        masks = ~np.zeros((len(codes), self.rows.shape[1]), dtype=np.uint64)
        for places in _positions(codes, len(self.rows)):
            masks &= self.rows[places]
        n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        hits = [np.bincount(row, self._bit(masks, at), minlength=len(texts)) for at in range(len(self.langs))]
        shares = np.array(hits).T / n[:, None]
        return np.clip((shares - self.chance) / (1 - np.minimum(self.chance, 0.999)), 0, 1)


def learn(docs: DataFrame, min_share: float = MIN_SHARE, positions: int = POSITIONS) -> Filter:
    """The filter of rows of (lang, text)."""
    counts = settled(ngram_counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())))
    totals = settled(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    langs = sorted(row.lang for row in totals.select("lang").collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "number int, lang string")
    common = (
        counts.join(totals, "lang").where(F.col("n") >= F.col("total") * min_share)
        .join(F.broadcast(numbers), "lang").select("number", "ngram")
    )

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy()
            for places in _positions(batch.column("ngram").to_numpy(), positions):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(places), pa.array(number // 64, pa.int32()),
                        pa.array((np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)),
                    ],
                    ["position", "word", "mask"],
                )

    # At most one row per filter word, whatever was counted.
    found = common.mapInArrow(bits, "position bigint, word int, mask bigint").groupBy("position", "word").agg(
        F.bit_or("mask").alias("mask")
    ).toPandas()
    rows = np.zeros((positions, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    rows[found["position"].to_numpy(np.int64), found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return Filter(langs, rows)


def predicted(docs: DataFrame, learned: Filter) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its text alone."""
    known = docs.sparkSession.sparkContext.broadcast(learned)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = known.value
        names = np.array([*filters.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch):
                letters = np.array(part.column("letters").to_pylist(), dtype=bool)
                best, score = np.full(len(letters), len(names) - 1), np.zeros(len(letters))
                if filters.langs:
                    shares = filters.shares([text or "" for text in part.column("text").to_pylist()])
                    best = np.where(letters, shares.argmax(axis=1), best)
                    score = np.where(letters, shares.max(axis=1), score)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    return rows.mapInArrow(work, f"doc_id {id_type}, lang_pred string, score double")


def identified(docs: DataFrame, min_share: float = MIN_SHARE, positions: int = POSITIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the labelled rows outside the held fold."""
    learned = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"), min_share, positions)
    return predicted(docs, learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
