"""Corpus pipeline over `documents`: one stage after another, each written and read again.

Quality rules drop documents, near duplicates leave one of each group, documents with
benchmark windows go, the mix takes documents as often as their source's target asks for,
and every row of the mix gets its shard. All stages but the last return the columns of
their input.

Defined results of every stage: a null text counts as empty, so the quality rules reject it;
a null id is an id like any other, and rows that repeat an id are told apart by their texts;
texts are read whole, whatever their length; rows equal in id and text are one document to
the near duplicates; extra columns pass through under any name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlots.llm import decontaminate, mixing, quality, sharding, simhash
from textlots.llm.common import deleted, documents, settled, stored_at, table
from textlots.session import work_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: three-word SimHash fingerprints that at most two bits part."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its shard and virtual slot, by a stored slot map."""
    folder = work_dir(spark, "slot-map")
    sharding.store_map(sharding.rebalanced(settled(sharding.slot_sizes(docs))), folder)
    return sharding.sharded(docs, sharding.load_map(spark, folder))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

# Linked fingerprints, hashed likelihoods and balanced sampling have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's rows are deleted once the next one's are written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = work_dir(spark, name.replace(" ", "-"))
        docs = stored_at(stage(spark, docs, sf_dir), path)
        if before:
            deleted(spark, before)
        before = path
    return docs
