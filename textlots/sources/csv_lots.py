"""CSV files of a lot as rows of cells, read by many tasks even where cells hold line breaks.

A task reads lines of its part of a file and does not know whether its first line begins a
record or goes on inside a quoted cell. So every part is first read as a function: where it
ends, outside or inside a cell, for either way to begin. Composing these functions along a
file, one row per part, tells how each part begins. Then each part yields the records that
lie in it, and what it holds of records that cross its ends as fragments, which are put
together per file. A quote counts only where a cell may begin or end, as in any CSV reader.

Rows keep their cells by place, and the header is data: files of any number of different
headers are read, and their text columns found, by the same few jobs.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlots.operators.ingest import drop_junk, header_points, usable_length
from textlots.operators.joins import narrow_join, settled

# What a read that fails on a task raises: from a query, and from a checkpoint.
READ_ERRORS = (PySparkException, Py4JJavaError)
RECORD, HEAD, TAIL = 0, 1, 2
LINES = "path string, source string, block bigint, value string"
ROWS = "path string, source string, block bigint, place bigint, kind int, value string, cells array<string>"

# From inside a quoted cell to its closing quote; a doubled quote is part of the cell.
_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell, if it begins inside one or at a cell's start."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            closed = _CLOSE.match(line, at if inside else at + 1)
            if not closed:
                return True
            at, inside = closed.end(), False
        at = line.find(",", at) + 1
        if not at:
            return False


def cells_of(record: str) -> list[str | None]:
    """The cells of one record; an empty cell is null."""
    if '"' not in record:
        return [cell or None for cell in record.split(",")]
    csv.field_size_limit(sys.maxsize)
    return [cell or None for cell in next(csv.reader(io.StringIO(record, newline="")), [])]


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), "value",
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The parts of files that a task reads, each with its lines in order."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in ("path", "source", "block", "value")))

    for part, lines in groupby(rows(), key=lambda row: row[:3]):
        yield part, (line[3] for line in lines)


def inside_starts(lines: DataFrame) -> set[tuple[str, int]]:
    """(file, byte) of the parts that begin inside a cell.

    Only such parts come to the driver: about 100 bytes for each ``spark.sql.files.maxPartitionBytes``
    of text, 80 MB for 100 TB at worst.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, _, block), own in _parts(batches):
            outside, inside = False, True
            for line in own:
                outside, inside = ends_inside(line, outside), ends_inside(line, inside)
            yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "outside": outside, "inside": inside}])

    ends = lines.select("path", "source", "block", "value").mapInArrow(
        work, "path string, block bigint, outside boolean, inside boolean"
    )
    steps = ends.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "outside", "inside"))).alias("steps"))

    def step(state: Column, one: Column) -> Column:
        now = F.when(state["now"], one["inside"]).otherwise(one["outside"])
        begun = F.when(state["now"], F.array_append(state["begun"], one["block"])).otherwise(state["begun"])
        return F.struct(begun.alias("begun"), now.alias("now"))

    start = F.struct(F.array().cast("array<bigint>").alias("begun"), F.lit(False).alias("now"))
    begun = F.aggregate("steps", start, step)["begun"]
    return {(row.path, row.block) for row in steps.select("path", F.explode(begun).alias("block")).collect()}


def read_rows(spark: SparkSession, paths: Sequence[str], multi_line: bool = True) -> DataFrame:
    """(path, source, row_no, cells) of every record, written once below the shared folder."""
    lines = _lines(spark, paths)
    starts: set[tuple[str, int]] = set()
    if multi_line:
        # Files below the size that opening one counts for are never divided.
        undivided = _bytes(spark, "spark.sql.files.openCostInBytes")
        starts = inside_starts(lines.where(F.col("bytes") > undivided))
    begun = spark.sparkContext.broadcast(starts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("place", pa.int64()),
            ("kind", pa.int32()), ("value", pa.string()), ("cells", pa.list_(pa.string())),
        ])
        held: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(column, field.type) for column, field in zip(zip(*held), schema)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for (path, source, block), own in _parts(batches):
            inside = (path, block) in begun.value
            kind, open_lines, place = (HEAD if inside else RECORD), [], 0
            for line in own:
                open_lines.append(line)
                inside = multi_line and ends_inside(line, inside)
                if inside:
                    continue
                record = "\n".join(open_lines).removesuffix("\r")
                if kind == HEAD:
                    held.append((path, source, block, place, HEAD, record, None))
                elif record:
                    held.append((path, source, block, place, RECORD, None, cells_of(record)))
                kind, open_lines, place = RECORD, [], place + 1
                if len(held) >= 5_000:
                    yield flushed()
            if open_lines:
                # Goes on in the next part; one that began inside a cell and ends inside it is all a middle.
                held.append((path, source, block, place, kind if kind == HEAD else TAIL, "\n".join(open_lines), None))
        if held:
            yield flushed()

    found = settled(lines.select("path", "source", "block", "value").mapInArrow(work, ROWS))
    # A record takes a byte at least: the number stays below the byte where the next part begins.
    number = F.col("block") + F.col("place")
    whole = found.where(F.col("kind") == RECORD).select("path", "source", number.alias("row_no"), "cells")
    return whole.unionAll(_joined(found.where(F.col("kind") != RECORD).withColumn("row_no", number)))


def _bytes(spark: SparkSession, name: str) -> int:
    value = spark.conf.get(name).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(value[-1:], 1)
    return int(value.rstrip("kmg")) * unit


def _joined(fragments: DataFrame) -> DataFrame:
    """Records put together from what the parts of a file hold of them: two fragments a part at most."""
    so_far = Window.partitionBy("path").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = fragments.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(so_far))
    texts = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    records = numbered.groupBy("path", "source", "record").agg(F.min("row_no").alias("row_no"), texts.alias("texts"))
    text = F.array_join(F.transform("texts", lambda one: one["value"]), "\n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [cells_of(record.removesuffix("\r")) for record in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("path", "source", "row_no")), pa.array(cells, pa.list_(pa.string()))],
                ["path", "source", "row_no", "cells"],
            )

    return records.select("path", "source", "row_no", text.alias("record")).mapInArrow(
        work, "path string, source string, row_no bigint, cells array<string>"
    )


def read_each(
    paths: Sequence[str], read: Callable[[list[str]], DataFrame], files: Callable[[], list[str]]
) -> tuple[list[DataFrame], dict[str, str]]:
    """What ``read`` makes of the files that can be read whole, and the error of each that cannot.

    ``read`` materialises. A failed read is divided into halves until the bad files stand
    alone: one bad file costs a read per halving, all others stay whole.
    """
    try:
        return [read(list(paths))], {}
    except READ_ERRORS:
        pass
    made, errors = [], {}
    waiting = [sorted(files())]
    while waiting:
        some = waiting.pop()
        try:
            made.append(read(some))
        except READ_ERRORS as error:
            if len(some) == 1:
                errors[some[0]] = _message(error)
            elif some:
                waiting += [some[: len(some) // 2], some[len(some) // 2 :]]
    return made, errors


def _message(error: Exception) -> str:
    """What the file system said, rather than what failed because of it."""
    lines = [line for line in str(error).split("\n") if line.startswith("Caused by: ")] or str(error).strip().split("\n")
    return lines[-1].removeprefix("Caused by: ")[:300]


def detect_places(rows: DataFrame, header: str | bool = "auto") -> DataFrame:
    """Per file: place and name of the text column, score, texts, and the row from which texts are taken.

    One aggregate over (file, place), whatever the headers are. With ``auto`` a file without
    any usable text below its first row has that row as data.
    """
    first = rows.groupBy("path", "source").agg(F.min("row_no").alias("first_row"), F.min_by("cells", "row_no").alias("header"))
    first = settled(first)
    cells = narrow_join(rows, first.select("path", "first_row"), ["path"]).select(
        "path", (F.col("row_no") == F.col("first_row")).alias("on_top"), F.posexplode("cells").alias("at", "cell")
    )
    sizes = cells.select("path", "at", "on_top", usable_length(F.col("cell")).alias("chars"))
    sums = sizes.groupBy("path", "at").agg(
        F.count(F.when(~F.col("on_top"), F.col("chars"))).alias("below_n"),
        F.sum(F.when(~F.col("on_top"), F.col("chars"))).alias("below_sum"),
        F.count("chars").alias("n"), F.sum("chars").alias("sum"),
    )
    unnamed = F.concat(F.lit("col_"), F.col("at").cast("string"))
    placed = narrow_join(sums, first, ["path"]).withColumn("given", F.nullif(F.get("header", F.col("at")), F.lit("")))
    placed = placed.withColumn("points", header_points(F.col("given")))
    named = F.when(F.trim("given") != "", F.col("given")).otherwise(unnamed)

    def best(name: Column, points: Column, total: str, n: str) -> Column:
        score = points + F.col(total).cast("double") / F.col(n)
        rated = F.struct(score.alias("score"), (-F.col("at")).alias("order"), name.alias("name"), F.col(n).alias("n"))
        return F.max(F.when(F.col(n) > 0, rated))

    scored = placed.groupBy("path", "source", "first_row").agg(
        best(named, F.col("points"), "below_sum", "below_n").alias("below"),
        best(unnamed, F.lit(0.0), "sum", "n").alias("all"),
    )
    below = F.lit(False) if header is False else F.col("below").isNotNull() if header == "auto" else F.lit(True)
    chosen = F.when(below, F.col("below")).otherwise(F.col("all"))
    return scored.withColumn("chosen", chosen).select(
        "path", "source",
        (-F.col("chosen.order")).alias("at"),
        F.col("chosen.name").alias("column_detected"),
        F.col("chosen.score").alias("score"),
        F.coalesce("chosen.n", F.lit(0)).cast("bigint").alias("n_texts"),
        F.when(below, F.col("first_row") + 1).otherwise(F.col("first_row")).alias("from_row"),
    )


def read_csv_lot(
    spark: SparkSession, paths: Sequence[str], batch_id: str = "lot", header: str | bool = "auto",
    multi_line: bool = True, isolate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(batch_id, source, row_no, text) of usable texts, and a status row per file.

    Status: column_detected, score, n_texts, and ``error``: why a file could not be read (no
    row of it is kept then) or that it holds no text column. Without ``isolate`` a file that
    cannot be read fails the lot. Files are told apart by path, listed by name.
    """

    def read(some: list[str]) -> DataFrame:
        return settled(read_rows(spark, some, multi_line))

    def listed() -> list[str]:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
        return [row.path for row in files.select("path").collect()]

    made, errors = read_each(paths, read, listed) if isolate else ([read(list(paths))], {})
    rows = spark.createDataFrame([], "path string, source string, row_no bigint, cells array<string>")
    for part in made:
        rows = rows.unionAll(part)
    found = settled(detect_places(rows, header))
    texts = narrow_join(rows.drop("source"), found.where("at IS NOT NULL").select("path", "source", "at", "from_row"), ["path"])
    texts = texts.where(F.col("row_no") >= F.col("from_row")).select(
        F.lit(batch_id).alias("batch_id"), "source", "row_no", F.get("cells", F.col("at")).alias("text")
    )
    failed = spark.createDataFrame(
        [(path.rsplit("/", 1)[-1], message) for path, message in errors.items()], "source string, error string"
    )
    nothing = F.when(F.col("column_detected").isNull(), F.concat(F.lit("no text column found in "), F.col("source")))
    status = found.select("source", "column_detected", "score", "n_texts", nothing.alias("error")).unionByName(
        failed.withColumn("n_texts", F.lit(0).cast("bigint")), allowMissingColumns=True
    )
    return drop_junk(texts), status.select(F.lit(batch_id).alias("batch_id"), "*")
