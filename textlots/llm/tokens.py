"""Exact token counts without token ids.

Every distinct pre-token is encoded once, anywhere in the cluster. The counts meet the
pre-token frequencies of the documents: the ``COMMON`` most frequent ones in a table that
every task holds (at most ``COMMON`` parts of at most 64 characters), all others in a
shuffled join. No switch: both ways run at every size.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated documents each keep
their row; texts of any length are counted whole; other columns of the input, whatever their
names, are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlots.llm import pretokens
from textlots.llm.common import keyed, per_copy, slices, stored

COMMON = 400_000
COMMON_CHARS = 64
# Distinct parts that a task gathers before it hands them on.
GATHERED = 400_000


def distinct_parts(docs: DataFrame) -> DataFrame:
    """(part, n): occurrences of every distinct pre-token."""

    def gathered(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["part", "n"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    counts.update(pretokens.cut(text or ""))
                if len(counts) > GATHERED:
                    yield gathered(counts)
                    counts.clear()
        yield gathered(counts)

    found = docs.select("text").mapInArrow(work, "part string, n bigint")
    return found.groupBy("part").agg(F.sum("n").alias("n"))


def counted_parts(parts: DataFrame, path: str) -> DataFrame:
    """(part, n, tokens): the parts with their number of tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pretokens.encoder(path)
        for batch in batches:
            tokens = [encoder.count(part) for part in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], ["part", "n", "tokens"])

    return parts.mapInArrow(work, "part string, n bigint, tokens bigint")


def common_parts(parts: DataFrame, common: int) -> pa.Table:
    """(part, tokens) of the most frequent short parts, ``common`` rows at most.

    Parts are chosen by steps of their frequency, so nothing is sorted.
    """
    short = parts.where(F.length("part") <= COMMON_CHARS)
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = short.groupBy(step.alias("step")).agg(F.count("*").alias("parts")).collect()
    least, total = None, 0
    for row in sorted(steps, reverse=True):
        total += row.parts
        if total > common:
            break
        least = row.step
    chosen = short.where(step >= least) if least is not None else short.limit(0)
    return chosen.select("part", "tokens").toArrow()


def token_counts(docs: DataFrame, path: str, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document, for the tokenizer file at ``path``."""
    rows = keyed(docs)
    parts = stored(counted_parts(distinct_parts(docs), path), "pretokens")
    frequent = common_parts(parts, common)
    known = docs.sparkSession.sparkContext.broadcast(
        dict(zip(frequent.column("part").to_pylist(), frequent.column("tokens").to_pylist()))
    )
    kind = rows.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for part in slices(batch):
                ids, hashes = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
                at, others, times, sums = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    total = 0
                    for piece, n in Counter(pretokens.cut(text or "")).items():
                        tokens = table.get(piece)
                        if tokens is None:
                            at.append(row)
                            others.append(piece)
                            times.append(n)
                            sums.append(0)
                        else:
                            total += n * tokens
                    # The document's own row has no part.
                    at.append(row)
                    others.append(None)
                    times.append(len((text or "").encode()))
                    sums.append(total)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[row] for row in at], part.schema.field("doc_id").type),
                        pa.array([hashes[row] for row in at], pa.int64()),
                        pa.array(others, pa.string()), pa.array(times, pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "text_hash", "piece", "n", "tokens"],
                )

    found = stored(
        rows.mapInArrow(
            work, f"doc_id {kind.simpleString()}, text_hash bigint, piece string, n bigint, tokens bigint"
        ),
        "frequencies",
    )
    rest = (
        found.where("piece IS NOT NULL").select("doc_id", "text_hash", "piece", "n")
        .join(parts.select(F.col("part").alias("piece"), F.col("tokens").alias("each")), "piece")
        .select("doc_id", "text_hash", F.lit(0).alias("copies"), F.lit(0).alias("n_bytes"),
                (F.col("n") * F.col("each")).alias("tokens"))
    )
    own = found.where("piece IS NULL").select(
        "doc_id", "text_hash", F.lit(1).alias("copies"), F.col("n").alias("n_bytes"), "tokens"
    )
    totals = own.unionAll(rest).groupBy("doc_id", "text_hash").agg(
        F.sum("copies").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens")
    )
    # Equal rows add up in one group, and each gets its share back.
    return per_copy(
        totals.select("doc_id", "n_bytes", F.expr("tokens div copies").alias("n_tokens"), "copies"), "copies"
    )
