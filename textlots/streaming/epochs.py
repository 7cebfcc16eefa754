"""Tables that a stream writes epoch by epoch, read through a log of committed epochs.

Rows of an epoch are staged in a folder of their own; then one line of the log names it.
Readers take, for each epoch, the newest line: rows of an epoch that is being written, or
written again after a failure, are neither missed nor doubled, and a reader that holds the
older folder still finds its files. ``compact`` puts the committed epochs into one folder
and closes them: an epoch that is written again later on is then already there.

A line also holds the number of rows, observed while they were written. The observation stands
at the end of the plan, in tasks whose results count once even if executors are lost; further
up, in a stage before a shuffle, rows of a repeated task would count again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# ``closed`` lines hold all epochs up to theirs.
LOG = "epoch bigint, version bigint, part string, closed boolean, n_rows bigint"


def _log(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(LOG).json(f"{path}/log").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _newest(entries: list) -> tuple[int, list]:
    """The last closed epoch (-1: none), and the lines that a reader follows."""
    closed = max((e for e in entries if e.closed), key=lambda e: (e.epoch, e.version), default=None)
    last = closed.epoch if closed else -1
    chosen: dict[int, object] = {}
    for entry in sorted((e for e in entries if not e.closed and e.epoch > last), key=lambda e: e.version):
        chosen[entry.epoch] = entry
    return last, [*([closed] if closed else []), *chosen.values()]


def _commit(spark: SparkSession, path: str, epoch: int, version: int, part: str, closed: bool, n: int | None) -> None:
    spark.createDataFrame([(epoch, version, part, closed, n)], LOG).coalesce(1).write.mode("append").json(f"{path}/log")


def write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """Commit the rows as this epoch's, in place of what an earlier run of it committed."""
    spark = rows.sparkSession
    entries = _log(spark, path)
    if epoch <= _newest(entries)[0]:
        return
    part = uuid.uuid4().hex
    written = Observation()
    rows.observe(written, F.count("*").alias("n_rows")).write.parquet(f"{path}/parts/{part}")
    version = 1 + max((e.version for e in entries if e.epoch == epoch), default=0)
    _commit(spark, path, epoch, version, part, closed=False, n=written.get.get("n_rows", 0))


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed epochs."""
    chosen = _newest(_log(spark, path))[1]
    if not chosen:
        raise ValueError(f"no epoch is committed at {path}")
    return spark.read.parquet(*[f"{path}/parts/{entry.part}" for entry in chosen])


def epoch_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows that each epoch committed, closed ones included; of a repeated epoch, its last run's. No table is read."""
    log = spark.read.schema(LOG).json(f"{path}/log").where(~F.col("closed"))
    newest = F.max("version").over(Window.partitionBy("epoch"))
    return log.withColumn("_newest", newest).where(F.col("version") == F.col("_newest")).select("epoch", "n_rows")


def compact(spark: SparkSession, path: str, target_bytes: int = 256 << 20) -> None:
    """Close the committed epochs in one folder of files of about ``target_bytes``; the job may go on meanwhile."""
    entries = _log(spark, path)
    chosen = _newest(entries)[1]
    if len(chosen) < 2:
        return
    rows = spark.read.parquet(*[f"{path}/parts/{entry.part}" for entry in chosen])
    size = int(rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
               .agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    part = uuid.uuid4().hex
    rows.coalesce(max(1, -(-size // target_bytes))).write.parquet(f"{path}/parts/{part}")
    last = max(entry.epoch for entry in chosen)
    _commit(spark, path, last, 1 + max(entry.version for entry in entries), part, closed=True, n=None)
