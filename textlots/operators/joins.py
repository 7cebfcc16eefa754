"""Joins that hold when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlots.session import use_checkpoints

# A key with this many rows is worth its own path, and this many keys at most take it.
# The bound is proven: keys beyond the limit hold at most rows / HOT_KEYS rows each.
HOT_ROWS = 100_000
HOT_KEYS = 4_096

# Rows of a narrow table that may be sent to every executor (about 10 MB).
BROADCAST_ROWS = 100_000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    weight: str,
    spread: Column,
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join of rows with a table of one row per key, exact under any skew.

    ``lookup[weight]`` counts the rows of a key. The heaviest keys are broadcast; their
    rows are served there and go through the shuffle under ``spread``, a value for the
    last key column that differs per row and never occurs in the lookup.
    """
    *outer, last = keys
    # The lookup serves both parts, and often took a full scan to compute: it is settled
    # once, which also keeps its partitioning for the join.
    lookup = settled(lookup.select(*keys, weight, *payload))
    found = F.struct(*payload)
    hot = (
        lookup.where(F.col(weight) >= hot_rows)
        .orderBy(F.desc(weight), *keys)
        .limit(hot_keys)
        .select(*keys, found.alias("_hot"))
    )
    tail = lookup.select(*outer, F.col(last).alias("_key"), found.alias("_tail"))
    joined = (
        rows.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_key", F.when(F.col("_hot").isNull(), F.col(last)).otherwise(spread))
        .join(tail, [*outer, "_key"], "left")
    )
    either = F.coalesce("_hot", "_tail")
    return joined.select(
        *[F.col(name) for name in rows.columns],
        *[either[name].alias(name) for name in payload],
    )


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow_join(rows: DataFrame, narrow: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a settled narrow table: broadcast if its counted size allows, else shuffled.

    In the shuffled case the adaptive planner splits oversized partitions.
    """
    if narrow.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(narrow), list(keys), how)
    return rows.join(narrow.hint("merge"), list(keys), how)
