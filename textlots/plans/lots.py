"""A lot from raw texts to result rows.

The measures of a text (token counts, rewrite, winning rule) are expressions, so they are
computed where a row is scanned, and only they and a 16-byte key are shuffled to find the
first copy of each text: one narrow shuffle, no text in it. Totals and type counts then
come from these canonical rows weighted by their number of copies; only the row table
itself needs the join back.

Where the rewrite is a user's function, the order is
turned round: texts are reduced to canonical rows first and measured once each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlots.functions.numbers import share_pct
from textlots.functions.rewrite import dict_rewrite
from textlots.operators.classify import classification, hint_keys, with_hints, with_rule
from textlots.operators.dedup import BATCH, ORDER, canonical, with_canonical, with_key
from textlots.operators.ingest import drop_junk, mark_junk
from textlots.operators.joins import narrow_join, settled
from textlots.operators.near_dup import vector_dedup
from textlots.operators.rewrite import rewrite_with
from textlots.operators.tokens import with_tokens
from textlots.packs import Pack
from textlots.packs.prices import PREVIEW_CHARS, PREVIEW_ROWS
from textlots.plans.state import merged_near

BatchFn = Callable[[Sequence[str]], Sequence[str]]


def ingest(df: DataFrame) -> DataFrame:
    """Usable texts of a lot with their dedup key."""
    return with_key(drop_junk(df.select(*BATCH, *ORDER, "text")))


def measure(
    df: DataFrame,
    pack: Pack,
    optimize: bool = True,
    batch_fn: BatchFn | None = None,
) -> DataFrame:
    """Add token counts before and after the rewrite, the rewrite and the winning rule."""
    counted = with_tokens(df, "text", "tokens_original")
    if not optimize:
        rewritten = counted.withColumns(
            {
                "text_optimized": F.lit(""),
                "optimize_method": F.lit("none"),
                "tokens_optimized": F.col("tokens_original"),
            }
        )
    else:
        if batch_fn is None:
            rewritten = counted.withColumn("text_optimized", dict_rewrite(F.col("text"))).withColumn(
                "optimize_method", F.lit("dictionary")
            )
        else:
            rewritten = rewrite_with(counted, "text", batch_fn)
        rewritten = with_tokens(rewritten, "text_optimized", "tokens_optimized")
    return with_hints(with_rule(rewritten, pack), pack)


def stages(raw: DataFrame, pack: Pack) -> DataFrame:
    """Distinct texts of raw cells with their rule and copies; unusable cells of a lot are one row with an empty key."""
    rows = with_key(mark_junk(raw.select(*BATCH, *ORDER, "text")))
    return canonical(with_rule(rows, pack), ["rule"])


def measures(pack: Pack) -> list[str]:
    return ["tokens_original", "tokens_optimized", "optimize_method", "rule", *hint_keys(pack)]


def analyze(
    texts: DataFrame,
    pack: Pack,
    optimize: bool = True,
    batch_fn: BatchFn | None = None,
    with_text: bool = False,
    near: DataFrame | None = None,
) -> DataFrame:
    """Canonical rows of ingested texts with their measures and number of copies.

    ``with_text`` also carries the whole rewrite, for row tables. ``near`` maps canonical
    rows to those they are near duplicates of (``near_dup.vector_dedup``): they then count
    as copies of these.
    """
    carry = measures(pack) + (["text_optimized"] if with_text else [])
    if batch_fn is None:
        canon = canonical(measure(texts, pack, optimize), carry)
    else:
        # Python stages run on each distinct text once.
        firsts = settled(canonical(texts, ["text"]))
        rows = measure(firsts, pack, optimize, batch_fn)
        canon = rows.select(*BATCH, "key", "n_rows", "canon_source", "canon_row_no", *carry)
    return canon if near is None else merged_near(settled(canon), near)


def near_map(texts: DataFrame, vectors: DataFrame, vec: str = "embedding", **how) -> DataFrame:
    """Near duplicates among the first rows of the texts that have a vector.

    ``vectors`` holds batch_id, source, row_no and the vector of a row's text.
    """
    firsts = canonical(texts.select(*BATCH, *ORDER, "key"))
    places = firsts.select(*BATCH, F.col("canon_source").alias("source"), F.col("canon_row_no").alias("row_no"))
    return settled(vector_dedup(vectors.join(places, [*BATCH, *ORDER], "left_semi"), vec, **how))


def expand(texts: DataFrame, canon: DataFrame, payload: Sequence[str], **options: int) -> DataFrame:
    """Every row with the measures of its canonical row, but its own source and text."""
    return with_canonical(texts.select(*BATCH, *ORDER, "key", "text"), canon, payload, **options)


def with_savings(df: DataFrame, optimized: bool = True) -> DataFrame:
    """Tokens saved per row (may be negative) and their share; 0 without a rewrite."""
    saved = F.col("tokens_original") - F.col("tokens_optimized")
    return df.withColumn(
        "savings_tokens", saved if optimized else F.lit(0).cast("bigint")
    ).withColumn("savings_pct", share_pct(F.col("savings_tokens"), F.col("tokens_original"), 1))


def result_rows(
    texts: DataFrame,
    canon: DataFrame,
    pack: Pack,
    optimize: bool = True,
    method: str = "rules",
) -> DataFrame:
    """One record per row of the lot, with the classification as a struct."""
    rows = with_savings(expand(texts, canon, [*measures(pack), "text_optimized"]), optimize)
    return rows.select(
        *BATCH,
        *ORDER,
        "text",
        "text_optimized",
        "tokens_original",
        "tokens_optimized",
        "savings_tokens",
        "savings_pct",
        F.lit(optimize).alias("optimized"),
        "optimize_method",
        F.lit(method).alias("method"),
        classification(pack, "rule", method).alias("classification"),
    )


def result_table(rows: DataFrame, pack: Pack) -> DataFrame:
    """Flat export table: nine base columns, then the pack's own; no nulls."""

    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return rows.select(
        "batch_id",
        "row_no",
        filled(F.col("source")).alias("source_file"),
        filled(F.col("text")).alias("texto_original"),
        filled(F.col("text_optimized")).alias("texto_optimizado"),
        "tokens_original",
        F.col("tokens_optimized").alias("tokens_optimizado"),
        F.col("savings_tokens").alias("ahorro_tokens"),
        F.col("savings_pct").alias("ahorro_pct"),
        F.when(F.col("optimized"), "si").otherwise("no").alias("optimizado"),
        F.col("classification._method").alias("metodo_clasificacion"),
        *[filled(F.col(f"classification.{key}")).alias(key) for key in pack.result_keys],
    )


def preview(
    texts: DataFrame, pack: Pack, n: int = PREVIEW_ROWS, optimize: bool = True, chars: int = PREVIEW_CHARS
) -> DataFrame:
    """First ``n`` result rows of each lot, cut to ``chars``, with the size of the lot beside them.

    The rows are chosen first, ``n`` per lot, and only texts with their keys are measured.
    """
    in_order = Window.partitionBy(*BATCH).orderBy(*ORDER)
    sizes = texts.groupBy(*BATCH).agg(F.count("*").alias("results_total"))
    short = texts.withColumn("text", F.substring("text", 1, chars))
    chosen = settled(
        short.withColumn("position", F.row_number().over(in_order))
        .where(F.col("position") <= n)
        .join(sizes, list(BATCH))
    )
    keys = settled(chosen.select(*BATCH, "key").distinct())
    wanted = narrow_join(texts, keys, [*BATCH, "key"], "left_semi")
    shown = chosen.select(*texts.columns)
    rows = result_rows(shown, analyze(wanted, pack, optimize, with_text=True), pack, optimize)
    rows = rows.withColumn("text_optimized", F.substring("text_optimized", 1, chars))
    return rows.join(chosen.select(*BATCH, *ORDER, "position", "results_total"), [*BATCH, *ORDER])


def lot_summary(core: DataFrame, by: Sequence[str] = BATCH) -> DataFrame:
    """Key and value table of a lot's headline figures."""
    values = {
        "total_items": "item_count",
        "tokens_original": "tokens_original",
        "tokens_optimized": "tokens_optimized",
        "savings_tokens": "savings_tokens",
        "cost_original_usd": "cost_original_usd",
        "cost_optimized_usd": "cost_optimized_usd",
        "cost_savings_usd": "cost_savings_usd",
    }
    wide = core.select(
        *by,
        *[F.col(column).cast("double").alias(name) for name, column in values.items()],
        # Wall time is the caller's to know; the row keeps its place.
        F.lit(None).cast("double").alias("elapsed_ms"),
    )
    return wide.unpivot(list(by), [*values, "elapsed_ms"], "metrica", "valor")
