"""What the corpus operators share: table access, row keys, intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlots.operators.joins import settled
from textlots.session import work_dir

# Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Id, text and a hash of the text, which tells rows with equal or null ids apart.

    Other columns of the input, whatever their names, are left behind.
    """
    return docs.select("doc_id", "text", *more, F.xxhash64("text").alias("text_hash"))


def on_key(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, text_hash), where a null id equals a null id."""
    right = right.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    joined = left.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_id", "_hash")


def one_row_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One of the rows of ``docs``, all columns, for each distinct (doc_id, text_hash) of settled ``keys``.

    The texts are shuffled once: the join leaves equal rows side by side for the numbering.
    """
    names = fresh(docs, "id", "hash", "no")
    known, mark, number = names
    wanted = keys.select(id_text(keys["doc_id"]).alias(known), F.col("text_hash").alias(mark))
    rows = docs.withColumns({known: id_text(F.col("doc_id")), mark: F.xxhash64("text")})
    rows = rows.join(wanted, [known, mark], "left_semi")
    place = F.row_number().over(Window.partitionBy(known, mark).orderBy(known))
    return rows.withColumn(number, place).where(F.col(number) == 1).select(*[rows[c] for c in docs.columns])


def id_text(doc_id: Column) -> Column:
    """An id as text that differs from every other id's, a null's included."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, whatever its columns are called."""
    taken = {name.lower() for name in df.columns}
    made = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        made.append(name)
    return made


def per_copy(rows: DataFrame, copies: str) -> DataFrame:
    """One row for each of the equal input rows that a row stands for."""
    times = F.array_repeat(F.lit(0), F.col(copies).cast("int"))
    return rows.withColumn(copies, F.explode(times)).drop(copies)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read back: computed once, columnar on disk."""
    return stored_at(df, work_dir(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``stored_at`` that nothing reads any more, wherever it is kept."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``max_bytes`` of text each; a longer text comes alone."""
    lengths = batch.column(column).cast(pa.large_binary())
    offsets = _offsets(lengths)
    first = 0
    for row in range(1, batch.num_rows + 1):
        if row == batch.num_rows or offsets[row + 1] - offsets[first] > max_bytes:
            yield batch.slice(first, row - first)
            first = row


def _offsets(array: pa.LargeBinaryArray):
    import numpy as np

    ends = np.frombuffer(array.buffers()[1], dtype=np.int64)
    return ends[array.offset : array.offset + len(array) + 1]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; a null counts as empty."""
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]
