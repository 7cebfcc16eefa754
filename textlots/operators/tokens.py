"""Token counts: an estimate of word-like pieces, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlots.functions.text import piece_count

# What the counts are, for reports that name their tokenizer.
MODE = "native"


def with_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the number of word-like pieces; 0 for empty or null text."""
    return df.withColumn(out, piece_count(F.col(text)))
