"""Shortening texts: the dictionary, or a user's batch function with a fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlots.functions.rewrite import dict_rewrite
from textlots.functions.text import strip

# What each method label means.
METHOD_LABELS = {
    "ctranslate2": "Traducción neuronal local (CTranslate2 / OPUS-MT es→en)",
    "dictionary": "Fallback diccionario (motor CT2 no disponible)",
    "passthrough": "Sin optimización",
    "none": "Optimización desactivada",
}


def rewrite_with(
    df: DataFrame,
    text: str,
    batch_fn: Callable[[Sequence[str]], Sequence[str]],
    fallback: bool = True,
    method: str = "ctranslate2",
    out: str = "text_optimized",
) -> DataFrame:
    """Rewrite a column with a function over batches of texts; adds ``optimize_method``.

    Blank texts stay, an empty answer keeps the source. A batch that fails is tried again in
    halves, down to single texts; only the texts that fail alone are left to the dictionary
    (or passed through), and ``optimize_method`` tells them apart. Run it on canonical rows.
    """

    def answered(texts: list[str]) -> list[str | None]:
        try:
            answers = list(batch_fn(texts)) if texts else []
            if len(answers) != len(texts):
                raise ValueError("one answer per text is needed")
            return [a if a and a.strip() else s for a, s in zip(answers, texts)]
        except Exception:
            if len(texts) == 1:
                return [None]
            middle = len(texts) // 2
            return answered(texts[:middle]) + answered(texts[middle:])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            todo = sources[sources.notna()]
            result = pd.Series([None] * len(sources), index=sources.index, dtype=object)
            # A text that failed is marked by a null; the plan then takes the fallback.
            result.loc[todo.index] = answered(todo.tolist())
            yield result

    source = F.nullif(strip(F.col(text)), F.lit(""))
    blank = source.isNull()
    failed = ~blank & F.col("_answer").isNull()
    safe = dict_rewrite(F.col(text)) if fallback else F.col(text)
    label = "dictionary" if fallback else "passthrough"
    return (
        df.withColumn("_answer", run(source))
        .withColumn(
            out,
            F.when(blank, F.coalesce(F.col(text), F.lit("")))
            .when(failed, safe)
            .otherwise(F.col("_answer")),
        )
        .withColumn("optimize_method", F.when(failed, label).otherwise(method))
        .drop("_answer")
    )
