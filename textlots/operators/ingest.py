"""From raw cells to a lot of usable texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlots.functions.bind import bind, words
from textlots.functions.folding import plain
from textlots.functions.text import clean, junk_reason, normalize
from textlots.operators.joins import narrow_join, settled

# Header words that point to the text column.
HEADER_WORDS = (
    "review", "reseña", "resena", "comentario", "feedback", "texto", "opinion",
    "text", "comment", "incidencia", "descripcion", "descripción", "detalle",
    "mensaje", "nota", "observacion", "observación", "mensaje_texto",
    "solicitud", "clausula", "cláusula", "contenido", "body", "body_text",
    "content", "narrativa", "descripcion_problema", "problema",
)

LOT = ("batch_id", "source")
BUCKET = 10_000


def with_junk_reason(df: DataFrame, text: str = "text") -> DataFrame:
    """Clean the cell and say why it is unusable (null: usable)."""
    return df.withColumn(text, clean(F.col(text))).withColumn("junk_reason", junk_reason(F.col(text)))


def junk_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The cells that a lot leaves out, cleaned, with the reason."""
    return with_junk_reason(df, text).where(F.col("junk_reason").isNotNull())


def usable(cell: Column) -> Column:
    return junk_reason(cell).isNull()


def drop_junk(df: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned texts that are usable.

    A filter on the cleaned text would be pushed below the cleaning and repeat it once per
    test; an array of no or one text keeps it to a single pass.
    """
    kept = [name for name in df.columns if name != text]
    good = F.filter(F.array(clean(F.col(text))), usable)
    return df.select(*kept, F.explode(good).alias(text)).select(*df.columns)


def mark_junk(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row, with its cleaned text, or null where that is no usable one."""
    return df.withColumn(text, F.get(F.filter(F.array(clean(F.col(text))), usable), 0))


def header_score(name: str) -> int:
    """100 for every header word inside the accent-free, lower-case header."""
    folded = plain(name).lower().strip()
    return 100 * sum(word in folded for word in HEADER_WORDS)


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def header(name: str) -> Column:
    """The column under a header that may hold dots or backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_scores(
    df: DataFrame, by: Sequence[str] = ("source",), columns: Sequence[str] | None = None
) -> DataFrame:
    """Score of every column of every source, as an array ``_scores``, plus ``n_cells``.

    One pass and one aggregate over all columns: nothing is unpivoted per cell.
    """
    names = list(columns) if columns is not None else text_columns(df, by)
    lengths = [
        bind(clean(header(name)), lambda cell: F.when(usable(cell), F.length(cell))).alias(f"_len{i}")
        for i, name in enumerate(names)
    ]
    sums = [F.sum(f"_len{i}").alias(f"_sum{i}") for i in range(len(names))]
    counts = [F.count(f"_len{i}").alias(f"_n{i}") for i in range(len(names))]
    grouped = df.select(*by, *lengths).groupBy(*by).agg(*sums, *counts)

    def score(i: int, name: str) -> Column:
        mean = F.col(f"_sum{i}").cast("double") / F.col(f"_n{i}")
        return F.when(
            F.col(f"_n{i}") > 0,
            F.struct(
                (F.lit(float(header_score(name))) + mean).alias("score"),
                F.lit(-i).alias("order"),
                F.lit(name).alias("column"),
                F.col(f"_n{i}").alias("n_texts"),
            ),
        )

    scores = F.array_compact(F.array(*[score(i, name) for i, name in enumerate(names)]))
    return grouped.select(*by, scores.alias("_scores"))


def detect_text_column(
    df: DataFrame, by: Sequence[str] = ("source",), columns: Sequence[str] | None = None
) -> DataFrame:
    """Best text column per source: ``column_detected``, ``score``, ``n_texts`` (nulls if none)."""
    best = F.array_max("_scores")
    return column_scores(df, by, columns).select(
        *by,
        best["column"].alias("column_detected"),
        best["score"].alias("score"),
        F.coalesce(best["n_texts"], F.lit(0)).cast("bigint").alias("n_texts"),
    )


def header_points(name: Column) -> Column:
    """100 for every header word inside the accent-free, lower-case header; 0 for none."""
    known = words(HEADER_WORDS)
    found = bind(normalize(name), lambda folded: F.size(F.filter(known, lambda word: F.contains(folded, word))))
    return F.coalesce(100.0 * found, F.lit(0.0))


def usable_length(cell: Column) -> Column:
    """Characters of the cleaned cell; null if it is no usable text."""
    return bind(clean(cell), lambda cleaned: F.when(usable(cleaned), F.length(cleaned)))


def detect_by_place(cells: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """``detect_text_column`` over cells in long form: ``at`` (place), ``name`` (header), ``cell``.

    The header is data, so files with any number of different headers take one aggregate.
    """
    sizes = cells.select(*by, "at", "name", usable_length(F.col("cell")).alias("_chars"))
    sums = sizes.groupBy(*by, "at", "name").agg(F.sum("_chars").alias("_sum"), F.count("_chars").alias("_n"))
    scored = sums.withColumn("score", header_points(F.col("name")) + F.col("_sum").cast("double") / F.col("_n"))
    rated = F.struct("score", (-F.col("at")).alias("order"), "name", F.col("_n").alias("n"))
    best = F.max(F.when(F.col("_n") > 0, rated))
    return scored.groupBy(*by).agg(best.alias("_best")).select(
        *by,
        F.col("_best.name").alias("column_detected"),
        F.col("_best.score").alias("score"),
        F.coalesce("_best.n", F.lit(0)).cast("bigint").alias("n_texts"),
    )


def pick_by_place(cells: DataFrame, detected: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Usable texts of each source's detected column, from cells in long form."""
    best = settled(detected.select(*by, F.col("column_detected").alias("name")).where(F.col("name").isNotNull()))
    rows = narrow_join(cells, best, [*by, "name"])
    return drop_junk(rows.select(*by, F.col("cell").alias("text")))


def pick_text(
    df: DataFrame, detected: DataFrame, by: Sequence[str] = ("source",), keep: Sequence[str] = ()
) -> DataFrame:
    """Usable texts of each source's detected column, as column ``text``."""
    best = settled(detected.select(*by, "column_detected").where(F.col("column_detected").isNotNull()))
    rows = narrow_join(df, best, by)
    chosen = F.coalesce(
        *[F.when(F.col("column_detected") == name, header(name)) for name in text_columns(df, by)]
    )
    return drop_junk(rows.select(*by, *keep, chosen.alias("text")))


def file_quotas(
    df: DataFrame, lot_rows: int, file_rows: int | None = None, by: Sequence[str] = LOT
) -> DataFrame:
    """Rows, rows kept and a truncation flag per file; files count in name order."""
    batch, source = by
    file_rows = lot_rows if file_rows is None else file_rows
    files = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.max("row_no").alias("_max_row"))
    capped = F.least(F.col("n_rows"), F.lit(file_rows).cast("bigint"))
    earlier = Window.partitionBy(batch).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(lot_rows).cast("bigint") - F.coalesce(F.sum(capped).over(earlier), F.lit(0))
    return files.withColumn(
        "n_kept", F.greatest(F.lit(0).cast("bigint"), F.least(capped, left))
    ).withColumn("truncated", F.col("n_kept") < F.col("n_rows"))


def last_rows(
    df: DataFrame, lot_rows: int, file_rows: int | None = None, by: Sequence[str] = LOT
) -> DataFrame:
    """Per file the last ``row_no`` inside the caps, as ``last_row``.

    A file cut in the middle is not sorted as a whole: its rows are counted by
    ranges of row numbers, and only the one range that holds the cut is ranked.
    """
    quotas = settled(file_quotas(df, lot_rows, file_rows, by))
    cut = quotas.where(F.col("truncated") & (F.col("n_kept") > 0)).select(*by, "n_kept")
    numbers = narrow_join(df.select(*by, "row_no"), cut, by).withColumn(
        "_bucket", F.floor(F.col("row_no") / BUCKET)
    )
    so_far = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        numbers.groupBy(*by, "_bucket", "n_kept")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(so_far))
        .where((F.col("_upto") >= F.col("n_kept")) & (F.col("_upto") - F.col("_n") < F.col("n_kept")))
        .select(*by, "_bucket", (F.col("n_kept") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    ranked = Window.partitionBy(*by, "_bucket").orderBy("row_no")
    ends = (
        numbers.select(*by, "_bucket", "row_no")
        .join(edge, [*by, "_bucket"])
        .withColumn("_rn", F.row_number().over(ranked))
        .where(F.col("_rn") == F.col("_rank"))
        .select(*by, F.col("row_no").alias("_cut_row"))
    )
    last = F.when(F.col("n_kept") == 0, F.lit(None)).otherwise(F.coalesce("_cut_row", "_max_row"))
    return quotas.join(ends, list(by), "left").withColumn("last_row", last).drop("_cut_row", "_max_row")


def cap_rows(
    df: DataFrame, lot_rows: int, file_rows: int | None = None, by: Sequence[str] = LOT
) -> DataFrame:
    """First ``lot_rows`` rows of each lot, files in name order, rows in row order.

    Nothing in the library cuts a lot unless a caller asks for it here.
    """
    ends = settled(last_rows(df, lot_rows, file_rows, by).select(*by, "last_row"))
    kept = narrow_join(df, ends, by).where(F.col("row_no") <= F.col("last_row"))
    return kept.drop("last_row")


def source_summary(
    texts: DataFrame, detected: DataFrame, quotas: DataFrame | None = None, by: Sequence[str] = LOT
) -> DataFrame:
    """Per file: usable rows, detected column, error text, truncation.

    ``row_count`` is what the lot really holds. Only a lot that was cut by ``cap_rows`` has
    truncated files: pass the ``file_quotas`` of that cut.
    """
    counts = texts.groupBy(*by).agg(F.count("*").alias("n_rows"))
    rows = detected.select(*by, "column_detected").join(counts, list(by), "left")
    cut = F.lit(False)
    if quotas is not None:
        rows = rows.join(quotas.select(*by, F.col("truncated").alias("_cut")), list(by), "left")
        cut = F.coalesce("_cut", F.lit(False))
    no_column = F.col("column_detected").isNull()
    return rows.select(
        *by,
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("row_count"),
        "column_detected",
        F.when(no_column, F.concat(F.lit("no text column found in "), F.col(by[-1]))).alias("error"),
        cut.alias("truncated"),
    )
