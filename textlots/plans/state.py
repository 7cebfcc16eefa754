"""The stored state of lots: canonical rows that merge when files are added.

A state is a folder. Every addition writes the canonical rows of the new texts alone, with
their measures, as one part; then one small file of the log names all parts of the new
version. Readers follow the newest version, so they never see half an addition, and an
addition that failed leaves a part that no version names. A text of two parts is one row
again when the state is read: copies add up, and the measures are those of its first row in
lot order, as if all files had been read at once. ``compact`` merges the parts for good.

Totals, distributions, comparisons and projections come from the state and read no text.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlots.operators.dedup import BATCH
from textlots.operators.joins import lookup_join, settled

LOG = "version bigint, part string, columns string"
IDENTITY = (*BATCH, "key", "n_rows", "canon_source", "canon_row_no")


def _versions(spark: SparkSession, path: str) -> list:
    """Version, part and column types of the newest version; empty for a new state."""
    from pyspark.errors import AnalysisException

    try:
        log = spark.read.schema(LOG).json(f"{path}/log/*")
        newest = log.agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(log.where(F.col("version") == newest).collect())


def _commit(spark: SparkSession, path: str, version: int, parts: Sequence[str], columns: str) -> None:
    """One file, moved into the log as a whole; a version that another writer took is an error."""
    rows = spark.createDataFrame([(version, part, columns) for part in parts], LOG)
    rows.coalesce(1).write.mode("error").json(f"{path}/log/{version:09d}")


def add(canon: DataFrame, path: str) -> None:
    """Add the canonical rows of further texts (``lots.analyze`` of them alone) to the state."""
    spark = canon.sparkSession
    known = _versions(spark, path)
    columns = canon.schema.simpleString()
    if known and known[0].columns != columns:
        raise ValueError(f"the state at {path} holds {known[0].columns}, not {columns}")
    part = uuid.uuid4().hex
    canon.write.parquet(f"{path}/parts/{part}")
    version = known[0].version + 1 if known else 1
    _commit(spark, path, version, [*[row.part for row in known], part], columns)


def _merged(rows: DataFrame) -> DataFrame:
    """One row per text of several parts."""
    measures = [name for name in rows.columns if name not in IDENTITY]
    first = F.min(F.struct("canon_source", "canon_row_no", *measures))
    merged = rows.groupBy(*BATCH, "key").agg(first.alias("_first"), F.sum("n_rows").alias("n_rows"))
    return merged.select(*[
        F.col(name) if name in (*BATCH, "key", "n_rows") else F.col(f"_first.{name}") for name in rows.columns
    ])


def load(spark: SparkSession, path: str) -> DataFrame:
    """The canonical rows of all files added so far."""
    known = _versions(spark, path)
    if not known:
        raise ValueError(f"no lot was added to the state at {path}")
    rows = spark.read.parquet(*[f"{path}/parts/{row.part}" for row in known])
    return rows if len(known) == 1 else _merged(rows)


def compact(spark: SparkSession, path: str) -> None:
    """Write a version of one merged part; parts of earlier versions stay for readers that still hold them."""
    known = _versions(spark, path)
    if len(known) < 2:
        return
    part = uuid.uuid4().hex
    load(spark, path).write.parquet(f"{path}/parts/{part}")
    _commit(spark, path, known[0].version + 1, [part], known[0].columns)


def with_near(canon: DataFrame, near: DataFrame, by: Sequence[str] = BATCH) -> DataFrame:
    """Canonical rows with the place and the measures of the row that each is kept as.

    ``near`` is a map of near duplicates over canonical rows (``near_dup.vector_dedup`` of
    their vectors); rows that it does not know stay what they are. Every exact text keeps
    its row and its number of copies, so that rows of a lot still find theirs by key.
    """
    return _composed(canon, near, by, [name for name in canon.columns if name not in {*by, "key", "n_rows"}])


def merged_near(canon: DataFrame, near: DataFrame, by: Sequence[str] = BATCH) -> DataFrame:
    """The canonical rows that near duplicates leave, with the copies of all texts that they stand for."""
    moved = settled(_composed(canon, near, by, ["canon_source", "canon_row_no"]).select(*by, "key", "n_rows", "canon_source", "canon_row_no"))
    copies = moved.groupBy(*by, "canon_source", "canon_row_no").agg(F.sum("n_rows").alias("n_rows"))
    return canon.drop("n_rows").join(copies, [*by, "canon_source", "canon_row_no"]).select(*canon.columns)


def _composed(canon: DataFrame, near: DataFrame, by: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """``canon`` with the payload of the rows that its rows are kept as."""
    place = ["canon_source", "canon_row_no"]
    moves = near.where("NOT is_canonical").select(
        *by, F.col("source").alias("canon_source"), F.col("row_no").alias("canon_row_no"),
        F.struct("canon_source", "canon_row_no").alias("_kept"),
    )
    placed = settled(canon.join(moves, [*by, *place], "left").withColumn(
        "_kept", F.coalesce("_kept", F.struct(*place))
    ))
    # One kept row may stand for a large part of the lot: it is looked up apart.
    weights = placed.groupBy(*by, "_kept").agg(F.count("*").alias("_n"))
    kept = canon.select(*by, F.struct(*place).alias("_kept"), F.struct(*payload).alias("_own"))
    rows = placed.select(*by, "key", "n_rows", "_kept", F.struct(*canon.columns).alias("_row"))
    named = _text_key(rows)
    found = lookup_join(
        named, _text_key(weights.join(kept, [*by, "_kept"])), [*by, "_place"], ["_own"], "_n",
        F.concat(F.lit("!"), F.hex("key")),
    )
    return found.select(*[
        F.col(f"_own.{name}") if name in payload else F.col(f"_row.{name}") for name in canon.columns
    ])


def _text_key(rows: DataFrame) -> DataFrame:
    """The kept place as one text; it begins with a digit or a minus sign."""
    return rows.withColumn("_place", F.concat_ws("/", "_kept.canon_row_no", F.coalesce("_kept.canon_source", F.lit("")))).drop("_kept")
