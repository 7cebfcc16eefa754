"""Exact duplicates: texts equal up to case and outer white space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlots.functions.numbers import round_even, share_pct
from textlots.functions.text import dedup_key
from textlots.operators.joins import HOT_ROWS, lookup_join

BATCH = ("batch_id",)
ORDER = ("source", "row_no")


def with_key(df: DataFrame, text: str = "text", by: Sequence[str] = BATCH) -> DataFrame:
    """Add the dedup key; a lot without a name becomes the lot named by an empty string."""
    named = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in by}
    return df.withColumns({**named, "key": dedup_key(F.col(text))})


def canonical(df: DataFrame, carry: Sequence[str] = (), by: Sequence[str] = BATCH) -> DataFrame:
    """One row per distinct text: its first row in lot order, ``carry`` of that row, ``n_rows``.

    Every map task first reduces its own copies to one, so a text that fills a third
    of a lot arrives as one row per task. Only ``carry`` travels: with measures instead
    of texts in it, the shuffle stays narrow.
    """
    first = F.min(F.struct(*ORDER, *carry))
    return (
        df.groupBy(*by, "key")
        .agg(first.alias("_first"), F.count("*").alias("n_rows"))
        .select(
            *by,
            "key",
            "n_rows",
            F.col("_first.source").alias("canon_source"),
            F.col("_first.row_no").alias("canon_row_no"),
            *[F.col("_first")[name].alias(name) for name in carry],
        )
    )


def row_spread() -> Column:
    """17 bytes per row: spreads rows like a key, and equals no 16-byte key."""
    return F.unhex(F.concat(F.md5(F.concat_ws("\0", F.col("source"), F.col("row_no"))), F.lit("00")))


def with_canonical(
    rows: DataFrame,
    canon: DataFrame,
    payload: Sequence[str],
    by: Sequence[str] = BATCH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Payload of each row's canonical row."""
    return lookup_join(rows, canon, [*by, "key"], payload, "n_rows", row_spread(), hot_rows)


def exact_dedup(
    df: DataFrame, by: Sequence[str] = BATCH, text: str = "text", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every row with the identity of its canonical row and a flag for canonical rows."""
    rows = with_key(df, text, by)
    copies = canonical(rows.select(*by, *ORDER, "key"), by=by).where(F.col("n_rows") > 1)
    mapped = with_canonical(rows, copies, ["canon_source", "canon_row_no"], by, hot_rows)
    source = F.coalesce("canon_source", "source")
    row_no = F.coalesce("canon_row_no", "row_no")
    return mapped.select(
        *df.columns,
        source.alias("canon_source"),
        row_no.alias("canon_row_no"),
        ((source == F.col("source")) & (row_no == F.col("row_no"))).alias("is_canonical"),
    )


def dedup_stats(canon: DataFrame, by: Sequence[str] = BATCH) -> DataFrame:
    """Rows in, canonical rows, removed rows, reduction in percent and as a ratio."""
    n, u = F.col("input_items"), F.col("canonical_items")
    return (
        canon.groupBy(*by)
        .agg(
            F.sum("n_rows").alias("input_items"),
            F.count("*").alias("canonical_items"),
        )
        .withColumn("removed_or_merged", n - u)
        .withColumn("reduction_pct", share_pct(F.col("removed_or_merged"), n, 2))
        .withColumn("dedup_ratio", round_even(1.0 - u.cast("double") / n.cast("double"), 3))
    )
