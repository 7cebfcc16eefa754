"""Files in, files out."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable, Sequence
from functools import partial
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlots.operators.ingest import detect_text_column, pick_text
from textlots.operators.ingest import header as header_column
from textlots.operators.joins import narrow_join, settled
from textlots.sources.csv_lots import read_csv_lot

FORMATS = ("csv", "json", "parquet", "orc", "text")
# Unpacked rows of one task of the sink.
TARGET_BYTES = 256 << 20
# Where Spark puts the text of a line that it cannot parse.
BROKEN = "_corrupt_record"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def file_order() -> Column:
    """A row number that follows the order of the rows in their file.

    High bits: the megabyte at which the task's split of the file starts; low bits: the
    row's place in the task. Splits start megabytes apart, so the order is that of the file.
    """
    megabyte = F.shiftright(F.col("_metadata.file_block_start"), 20)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(megabyte, 40) + place


def admit_files(
    spark: SparkSession,
    path: str | Sequence[str],
    extensions: Sequence[str],
    max_bytes: int | None = None,
    expected: Sequence[str] = (),
) -> DataFrame:
    """Status of every file: name, size and why it is refused (null: admitted).

    Only the listing is read; the ``content`` column is pruned. Spark's listing leaves out
    files without content, so names that should be there are given as ``expected``.
    """
    allowed = [F.lit(e.lower()) for e in extensions]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(name.alias("source"), F.col("length").alias("size_bytes"))
    if expected:
        names = spark.createDataFrame([(n,) for n in expected], "source string")
        absent = names.join(listed, "source", "left_anti")
        listed = listed.unionByName(absent.withColumn("size_bytes", F.lit(0).cast("bigint")))
    extension = F.lower(F.concat(F.lit("."), F.substring_index("source", ".", -1)))
    known = F.contains("source", F.lit(".")) & extension.isin(*allowed)
    too_large = F.lit(False) if max_bytes is None else F.col("size_bytes") > max_bytes
    limit = "" if max_bytes is None else f" exceeds the maximum size ({max_bytes // (1024 * 1024)} MB)"
    return listed.withColumn(
        "error",
        F.when(~known, F.concat(F.lit("type not allowed: "), "source"))
        .when(F.col("size_bytes") <= 0, F.concat(F.lit("empty or missing file: "), "source"))
        .when(too_large, F.concat("source", F.lit(limit))),
    )


def _read(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str,
    header: bool,
    multi_line: bool = True,
    base: str | None = None,
) -> DataFrame:
    """Files as they are. A damaged file fails the read with its name: half of one is never kept."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {', '.join(FORMATS)}")
    reader = spark.read
    if fmt == "csv":
        # inferSchema stays off: every cell is a string. A quote inside a cell is doubled.
        reader = reader.options(header=header, multiLine=multi_line, mode="PERMISSIVE", quote='"', escape='"')
    if fmt == "json":
        reader = reader.option("primitivesAsString", "true").option("mode", "PERMISSIVE")
    if base:
        reader = reader.option("basePath", base)
    return reader.format(fmt).load(list(paths))


def _first_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """First line of every file, by its path: one row per listed file reaches the driver."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), file_order().alias("place"), "value"
    )
    firsts = lines.groupBy("path").agg(F.min_by("value", "place").alias("line")).collect()
    return {unquote(row.path): row.line for row in firsts}


def _grouped(lines: dict[str, str], key: Callable[[str], object]) -> list[list[str]]:
    groups: dict[object, list[str]] = {}
    for path, line in sorted(lines.items()):
        groups.setdefault(key(line), []).append(path)
    return list(groups.values())


def _cells(raw: DataFrame, batch_id: str, header: bool) -> DataFrame:
    cells = []
    for i, f in enumerate(raw.schema.fields):
        if f.name == BROKEN:
            continue
        # Spark names a column without a header by its place.
        name = f.name if header and f.name.strip() and f.name != f"_c{i}" else f"col_{i}"
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cell = F.to_json(header_column(f.name))
        else:
            cell = header_column(f.name).cast("string")
        cells.append(cell.alias(name))
    return raw.select(
        F.lit(batch_id).alias("batch_id"), file_name().alias("source"), file_order().alias("row_no"), *cells
    )


def read_cells(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str,
    batch_id: str,
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """All columns of the files of a lot as strings, with file name and row number.

    CSV files are read by their own header: one read per distinct header, columns by name.
    ``multi_line`` lets a quoted cell go over several lines; without it large files are
    split over tasks, for files that are known to hold no such cell.
    """
    if fmt != "csv":
        return _cells(_read(spark, paths, fmt, header), batch_id, header)
    lines = _first_lines(spark, paths)
    if not lines:
        return _cells(_read(spark, paths, fmt, header, multi_line), batch_id, header)
    # Without a header only the number of columns has to agree.
    key = (lambda line: line) if header else (lambda line: len(next(csv.reader([line]), [])))
    reader_of = partial(_read, spark, fmt=fmt, header=header, multi_line=multi_line, base=_folder(paths, lines))
    parts = [reader_of(group) for group in _grouped(lines, key)]
    return unite(*[_cells(part, batch_id, header) for part in parts])


def _folder(paths: Sequence[str], files: Iterable[str]) -> str | None:
    """The one folder that was asked for, whose subfolders may name columns."""
    if len(paths) != 1 or any(sign in paths[0] for sign in "*?[{"):
        return None
    folder = paths[0].rstrip("/")
    return None if any(file.endswith(folder) for file in files) else folder


def broken_rows(spark: SparkSession, paths: Sequence[str], fmt: str, batch_id: str) -> DataFrame:
    """(batch_id, source, broken_rows) of files with lines that are no JSON."""
    if fmt != "json":
        return spark.createDataFrame([], "batch_id string, source string, broken_rows bigint")
    lines = spark.read.text(list(paths)).select(file_name().alias("source"), "value")
    broken = lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return broken.groupBy("source").agg(F.count("*").alias("broken_rows")).select(
        F.lit(batch_id).alias("batch_id"), "source", "broken_rows"
    )


def read_feedback(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "csv",
    batch_id: str = "lot",
    header: str | bool = "auto",
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Usable texts of a lot of files, and per file the detected column and its broken rows.

    With ``header='auto'`` a CSV file without any usable text below its first row has that
    row as data. A CSV file that cannot be read is a row with its ``error``, the lot goes on.
    """
    if fmt == "csv":
        texts, status = read_csv_lot(spark, paths, batch_id, header, multi_line)
        return texts, status.withColumn("broken_rows", F.lit(0).cast("bigint"))
    cells = read_cells(spark, paths, fmt, batch_id)
    by = ["batch_id", "source"]
    columns = [c for c in cells.columns if c not in (*by, "row_no")]
    broken = broken_rows(spark, paths, fmt, batch_id)
    detected = settled(
        detect_text_column(cells, by, columns).join(broken, by, "full_outer")
        .fillna(0, ["n_texts", "broken_rows"])
    )
    return pick_text(cells, detected, by, keep=["row_no"]), detected


def unite(*lots: DataFrame) -> DataFrame:
    """Files with different columns as one lot; missing columns are null."""
    first, *rest = lots
    for lot in rest:
        first = first.unionByName(lot, allowMissingColumns=True)
    return first


def write_results(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = ("batch_id",),
    target_bytes: int = TARGET_BYTES,
) -> None:
    """Write a result table, one folder per lot; a rerun replaces only the lots it holds.

    Tasks are dealt to lots by size: about ``target_bytes`` of unpacked rows make a task, so
    a large lot is spread over many and small lots share one. There are at most as many
    files as tasks and lots together.
    """
    rows = settled(df)
    writer = _dealt(rows, partition_by, target_bytes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.options(
            header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.partitionBy(*partition_by).format(fmt).save(path)


def _dealt(rows: DataFrame, by: Sequence[str], target_bytes: int) -> DataFrame:
    """Settled rows in partitions of about the target's size, each with few lots."""
    lot = F.to_json(F.struct(*by))
    width = sum(
        [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(8)
         for f in rows.schema.fields],
        F.lit(0),
    )
    sizes = settled(rows.groupBy(lot.alias("_lot")).agg(F.sum(width.cast("bigint")).alias("_bytes")))
    # All bytes of the table in one line, lot after lot: one row per lot meets here.
    upto = F.sum("_bytes").over(Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, 0))
    placed = settled(sizes.withColumn("_start", upto - F.col("_bytes")))
    total = placed.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    # A row's place in its lot is drawn by its place in the table: equal rows are spread too.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32)) / float(1 << 32)
    marked = rows.withColumns({"_lot": lot, "_part": part})
    task = F.floor((F.col("_start") + F.col("_part") * F.col("_bytes")) / target_bytes).cast("int")
    named = narrow_join(marked, placed, ["_lot"]).withColumn("_task", task)
    return named.repartitionById(max(1, -(-total // target_bytes)), "_task").select(*rows.columns)


def observed(df: DataFrame, name: str):
    """Count the rows that pass this point while some later action runs."""
    observation = Observation(name)
    return df.observe(observation, F.count("*").alias("n_rows")), observation
