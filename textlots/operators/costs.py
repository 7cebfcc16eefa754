"""Totals, prices, projections and break-even.

All functions below ``lot_core`` are projections over a table of totals with the columns
``tokens_original, tokens_optimized, item_count, optimize_enabled, price_per_million,
daily_volume`` and any key columns, which they keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlots.functions.numbers import at_least_one, cost_usd, round_even, share_pct, truncate
from textlots.functions.rules import rule_attr
from textlots.operators.rewrite import METHOD_LABELS
from textlots.operators.tokens import MODE
from textlots.packs import Pack
from textlots.packs.prices import DAILY_VOLUME, MONTH_DAYS, PRICE_PER_MILLION, PRICES

BATCH = ("batch_id",)
Prices = Sequence[tuple[str, str, str, float]]

# Advice beside the break-even point, and the note on the assumptions.
ADVICE_SAVES = "Conviene optimizar siempre con diccionario local (overhead ~0)."
ADVICE_OFF = "Activa optimización para medir ahorro real en este lote."
ADVICE_NONE = "El lote no genera ahorro medible con la optimización actual."
ASSUMPTION_NOTE = (
    "El paso de optimización actual usa diccionario local (0 tokens de API). "
    "El punto de equilibrio modela un preproceso LLM hipotético (~15% tokens del original)."
)

# Names and notes of the compared strategies.
STRATEGY_LABELS = {
    "a_dictionary": "Stub diccionario (referencia histórica)",
    "b_ctranslate2": "Traducción neuronal local (CTranslate2 OPUS-MT es→en)",
    "c_semantic_dedup": "Con deduplicación",
}
STRATEGY_NOTES = {
    "a_dictionary": "No es traducción real; no reportar como optimización profesional.",
    "b_ctranslate2": "Traducción real del lote (optimización ON).",
    "c_semantic_dedup": "Reduce cuántos textos se traducen; en lotes <40 solo exacta.",
}
NOTE_OFF = "Activa optimización para medir ahorro real CT2 en este lote."


def lot_totals(
    canon: DataFrame,
    price: float = PRICE_PER_MILLION,
    daily_volume: int = DAILY_VOLUME,
    optimize: bool = True,
    by: Sequence[str] = BATCH,
) -> DataFrame:
    """Sums over all rows of a lot, from its canonical rows weighted by ``n_rows``."""
    weighted = [
        F.sum(F.col("n_rows") * F.col(name)).alias(name) for name in ("tokens_original", "tokens_optimized")
    ]
    return (
        canon.groupBy(*by)
        .agg(*weighted, F.sum("n_rows").alias("item_count"), F.count("*").alias("unique_count"))
        .withColumn("optimize_enabled", F.lit(optimize))
        .withColumn("price_per_million", F.lit(float(price)))
        .withColumn("daily_volume", F.lit(daily_volume).cast("bigint"))
    )


def _costs() -> tuple[Column, Column]:
    price = F.col("price_per_million")
    return cost_usd(F.col("tokens_original"), price), cost_usd(F.col("tokens_optimized"), price)


def keys_of(totals: DataFrame) -> list[str]:
    known = {
        "tokens_original", "tokens_optimized", "item_count", "unique_count",
        "optimize_enabled", "price_per_million", "daily_volume",
    }
    return [name for name in totals.columns if name not in known]


def lot_core(totals: DataFrame) -> DataFrame:
    """Headline figures of a lot; savings keep their sign."""
    original, optimized = _costs()
    saved = F.col("tokens_original") - F.col("tokens_optimized")
    return totals.select(
        *keys_of(totals),
        "tokens_original",
        "tokens_optimized",
        saved.alias("savings_tokens"),
        share_pct(saved, F.col("tokens_original"), 2).alias("savings_pct"),
        "item_count",
        "unique_count",
        original.alias("cost_original_usd"),
        optimized.alias("cost_optimized_usd"),
        cost_usd(saved, F.col("price_per_million")).alias("cost_savings_usd"),
        F.col("optimize_enabled").alias("optimize_tokens"),
        "price_per_million",
    )


def lot_record(
    core: DataFrame, domain: str, method: str = "dictionary", dedup_method: str = "exact"
) -> DataFrame:
    """Headline figures with what they were made by: rewrite method and label, dedup, domain."""
    used = F.when(F.col("optimize_tokens"), method).otherwise("none")
    labels = F.create_map(*[F.lit(part) for pair in METHOD_LABELS.items() for part in pair])
    return core.withColumns({
        "optimize_method": used,
        "optimize_method_label": labels[used],
        "dedup_method": F.lit(dedup_method),
        "domain": F.lit(domain),
    })


def _averages() -> tuple[Column, Column]:
    items = at_least_one(F.col("item_count")).cast("double")
    return F.col("tokens_original") / items, F.col("tokens_optimized") / items


def _clamped_savings() -> Column:
    return F.greatest(F.col("tokens_original") - F.col("tokens_optimized"), F.lit(0).cast("bigint"))


def lot_batch(totals: DataFrame) -> DataFrame:
    """Averages and costs; token savings are never negative here, cost savings may be."""
    original, optimized = _costs()
    mean_original, mean_optimized = _averages()
    saved = _clamped_savings()
    return totals.select(
        *keys_of(totals),
        "item_count",
        "tokens_original",
        "tokens_optimized",
        saved.alias("savings_tokens"),
        share_pct(saved, F.col("tokens_original"), 2).alias("savings_pct"),
        round_even(mean_original, 2).alias("avg_tokens_original"),
        round_even(mean_optimized, 2).alias("avg_tokens_optimized"),
        original.alias("cost_original_usd"),
        optimized.alias("cost_optimized_usd"),
        round_even(original - optimized, 6).alias("cost_savings_usd"),
    )


def _scale() -> Column:
    return F.col("daily_volume").cast("double") / at_least_one(F.col("item_count")).cast("double")


def projection(totals: DataFrame) -> DataFrame:
    """The lot scaled to the daily volume: whole tokens per day, 30 such days per month."""
    day_original = truncate(F.col("tokens_original") * _scale())
    day_optimized = truncate(F.col("tokens_optimized") * _scale())
    days = totals.select(
        *keys_of(totals),
        "daily_volume",
        "price_per_million",
        day_original.alias("tokens_day_original"),
        day_optimized.alias("tokens_day_optimized"),
    )
    month_original = F.col("tokens_day_original") * MONTH_DAYS
    month_optimized = F.col("tokens_day_optimized") * MONTH_DAYS
    saved_day = F.col("tokens_day_original") - F.col("tokens_day_optimized")
    saved_month = month_original - month_optimized
    return days.select(
        *keys_of(totals),
        "daily_volume",
        "tokens_day_original",
        "tokens_day_optimized",
        month_original.alias("tokens_month_original"),
        month_optimized.alias("tokens_month_optimized"),
        saved_day.alias("savings_tokens_day"),
        saved_month.alias("savings_tokens_month"),
        cost_usd(saved_day, F.col("price_per_million")).alias("savings_usd_day"),
        cost_usd(saved_month, F.col("price_per_million")).alias("savings_usd_month"),
    )


def projection_30d(totals: DataFrame) -> DataFrame:
    """Accumulated savings for days 1 to 30: a multiple of the daily figure."""
    daily = truncate(_clamped_savings() * _scale())
    total = F.col("day") * F.col("_daily")
    return totals.select(
        *keys_of(totals),
        "price_per_million",
        daily.alias("_daily"),
        F.explode(F.sequence(F.lit(1), F.lit(MONTH_DAYS))).alias("day"),
    ).select(
        *keys_of(totals),
        "day",
        total.alias("cumulative_savings_tokens"),
        cost_usd(total, F.col("price_per_million")).alias("cumulative_savings_usd"),
    )


def _overhead() -> Column:
    return F.greatest(truncate(_averages()[0] * 0.15), F.lit(5).cast("bigint"))


def break_even(totals: DataFrame) -> DataFrame:
    """Items and tokens per item from which a paid rewrite step would pay off."""
    original, optimized = _averages()
    price = F.col("price_per_million")
    measured = totals.select(
        "*",
        _overhead().alias("_overhead"),
        cost_usd(_overhead(), price).alias("_overhead_usd"),
        cost_usd(F.greatest(original - optimized, F.lit(0.0)), price).alias("_saved_usd"),
        ((original - optimized) / F.greatest(original, F.lit(1.0))).alias("_share"),
    )
    pays = F.col("_saved_usd") > 0
    items = at_least_one(truncate(F.col("_overhead_usd") / F.nullif("_saved_usd", F.lit(0.0))))
    tokens = truncate(F.col("_overhead") / F.nullif("_share", F.lit(0.0)))
    return measured.select(
        *keys_of(totals),
        F.when(pays, items).alias("items"),
        F.when(pays & (F.col("_share") > 0), tokens).alias("tokens_per_item"),
        F.col("_saved_usd").alias("savings_per_item_usd"),
        F.col("_overhead_usd").alias("preprocess_cost_per_item_usd"),
        F.when(F.col("optimize_enabled") & (_clamped_savings() > 0), ADVICE_SAVES)
        .when(~F.col("optimize_enabled"), ADVICE_OFF)
        .otherwise(ADVICE_NONE)
        .alias("recommendation"),
    )


def assumptions(totals: DataFrame, tokenizer: str = MODE) -> DataFrame:
    """What the figures of a lot rest on."""
    return totals.select(
        *keys_of(totals),
        F.col("price_per_million").alias("price_per_million_usd"),
        "daily_volume",
        F.lit(MONTH_DAYS).alias("monthly_multiplier"),
        F.lit(tokenizer).alias("tokenizer"),
        "optimize_enabled",
        _overhead().alias("preprocess_tokens_per_item_estimate"),
        F.lit(ASSUMPTION_NOTE).alias("note"),
    )


def _with_models(df: DataFrame, prices: Prices) -> DataFrame:
    """A row per price: the price list is a literal, so nothing is joined."""
    models = [
        F.struct(
            F.lit(number).alias("number"),
            F.lit(model_id).alias("id"),
            F.lit(model).alias("model"),
            F.lit(provider).alias("provider"),
            F.lit(float(price)).alias("price_per_1m"),
        )
        for number, (model_id, model, provider, price) in enumerate(prices, start=1)
    ]
    return df.withColumn("_m", F.explode(F.array(*models))).select("*", "_m.*").drop("_m")


def model_costs(totals: DataFrame, prices: Prices = PRICES, tokens: str = "tokens_original") -> DataFrame:
    """Cost of a lot under every price; ``position`` ranks them, cheapest first."""
    keys = keys_of(totals)
    cost = cost_usd(F.col("tokens"), F.col("price_per_1m"))
    ranked = Window.partitionBy(*keys).orderBy("cost_usd", "number")
    return (
        _with_models(totals.select(*keys, F.col(tokens).alias("tokens")), prices)
        .withColumn("cost_usd", cost)
        .withColumn("position", F.row_number().over(ranked))
        .drop("number")
    )


def model_compare(totals: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """Cost before and after the rewrite side by side; cheapest after the rewrite first."""
    keys = keys_of(totals)
    price = F.col("price_per_1m")
    ranked = Window.partitionBy(*keys).orderBy("cost_optimized_usd", "cost_original_usd", "number")
    return (
        _with_models(totals.select(*keys, "tokens_original", "tokens_optimized"), prices)
        .withColumn("cost_original_usd", cost_usd(F.col("tokens_original"), price))
        .withColumn("cost_optimized_usd", cost_usd(F.col("tokens_optimized"), price))
        .withColumn(
            "savings_usd", round_even(F.col("cost_original_usd") - F.col("cost_optimized_usd"), 6)
        )
        .withColumn("position", F.row_number().over(ranked))
        .drop("number", "tokens_original", "tokens_optimized")
    )


def validate_scenarios(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``: null for a usable scenario."""
    checks = (
        (F.col("tokens_original") >= 0, "tokens_original below 0"),
        (F.col("tokens_optimized") >= 0, "tokens_optimized below 0"),
        (F.col("item_count") >= 1, "item_count below 1"),
        (F.col("price_per_million") > 0, "price_per_million not above 0"),
        (F.col("daily_volume") >= 1, "daily_volume below 1"),
    )
    reasons = [F.when(~F.coalesce(ok, F.lit(False)), reason) for ok, reason in checks]
    return df.withColumn("reject_reason", F.coalesce(*reasons))


def recalculate(scenarios: DataFrame) -> DataFrame:
    """All figures of each usable scenario from its totals alone: one projection, no join."""
    good = validate_scenarios(scenarios).where(F.col("reject_reason").isNull()).drop("reject_reason")
    given = good.columns
    for part in (lot_batch, projection, break_even):
        # Each part keeps the key columns, so what the others computed passes through.
        keep = good.withColumn("_given", F.struct(*given))
        figures = part(keep).withColumnsRenamed({"items": "break_even_items"})
        new = [name for name in figures.columns if name not in {*given, "_given"}]
        good = figures.select("_given.*", *[name for name in new])
        given = good.columns
    return good


def type_distribution(canon: DataFrame, pack: Pack, by: Sequence[str] = BATCH) -> DataFrame:
    """Rows per type, over all rows of the lot."""
    kind = rule_attr(F.col("rule"), pack, pack.type_key).alias("type")
    # Rules first, a small table; several rules, and the fallback, may be of one type.
    counts = canon.groupBy(*by, "rule").agg(F.sum("n_rows").alias("n"))
    return counts.select(*by, kind, "n").groupBy(*by, "type").agg(F.sum("n").alias("n"))


def top_types(distribution: DataFrame, k: int = 10, by: Sequence[str] = BATCH) -> DataFrame:
    """The ``k`` most frequent types of each lot."""
    ranked = Window.partitionBy(*by).orderBy(F.desc("n"), "type")
    return distribution.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= k)


def strategy_compare(
    canon: DataFrame,
    optimize: bool = True,
    method: str = "dictionary",
    dedup_method: str = "exact",
    dictionary: str = "tokens_optimized",
    by: Sequence[str] = BATCH,
) -> DataFrame:
    """Dictionary, rewrite and dedup side by side, from the counts of all distinct texts.

    ``is_primary`` marks the one to report: the rewrite where it ran, else none.
    """
    lots = canon.groupBy(*by).agg(
        F.sum("tokens_original").alias("_original"),
        F.sum(dictionary).alias("_dictionary"),
        F.sum("tokens_optimized").alias("_rewritten"),
        F.sum("n_rows").alias("_before"),
        F.count("*").alias("_after"),
    )
    original, before, after = F.col("_original"), F.col("_before"), F.col("_after")
    rewritten = F.col("_rewritten") if optimize else F.lit(None).cast("bigint")
    nothing = F.lit(None).cast("bigint")
    rows = [
        _strategy("a_dictionary", "dictionary", original, F.col("_dictionary")),
        _strategy("b_ctranslate2", method if optimize else "not_run", original, rewritten),
        _strategy(
            "c_semantic_dedup", dedup_method, original, nothing,
            items_before=before,
            items_after=after,
            tokens_canonical_original=original,
            tokens_canonical_translated=F.coalesce(rewritten, original),
            volume_reduction_pct=share_pct(before - after, before, 2),
        ),
    ]
    compared = lots.select(*by, F.inline(F.array(*rows)))
    notes = STRATEGY_NOTES if optimize else {**STRATEGY_NOTES, "b_ctranslate2": NOTE_OFF}

    def said(texts: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(F.col("strategy") == name, text) for name, text in texts.items()])

    return compared.withColumns({
        "label": said(STRATEGY_LABELS),
        "note": said(notes),
        "is_primary": (F.col("strategy") == "b_ctranslate2") & F.lit(optimize),
    })


def _strategy(name: str, method: str, original: Column, tokens: Column, **more: Column) -> Column:
    saved = original - tokens
    empty = {
        "items_before": "bigint", "items_after": "bigint", "tokens_canonical_original": "bigint",
        "tokens_canonical_translated": "bigint", "volume_reduction_pct": "double",
    }
    return F.struct(
        F.lit(name).alias("strategy"),
        F.lit(method).alias("method"),
        tokens.alias("tokens"),
        saved.alias("savings_vs_original"),
        share_pct(saved, original, 2).alias("savings_pct"),
        *[more.get(key, F.lit(None).cast(kind)).alias(key) for key, kind in empty.items()],
    )


def stage_counts(canon: DataFrame, by: Sequence[str] = BATCH) -> DataFrame:
    """Rows per lot after each stage: read, usable, distinct, matched by a rule.

    ``canon`` comes from ``lots.stages``: its row with an empty key stands for cells that are
    no usable text, so one scan and one shuffle give all counts.
    """
    n, used = F.col("n_rows"), F.col("key") != F.lit(b"")
    counted = canon.groupBy(*by).agg(
        F.sum(n).alias("read"),
        F.coalesce(F.sum(F.when(used, n)), F.lit(0)).alias("usable"),
        F.count_if(used).alias("distinct"),
        F.coalesce(F.sum(F.when(used & F.col("rule").isNotNull(), n)), F.lit(0)).alias("matched"),
    )
    return counted.unpivot(list(by), ["read", "usable", "distinct", "matched"], "stage", "n_rows")
