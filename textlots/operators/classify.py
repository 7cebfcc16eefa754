"""Rule packs over text: one scan, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlots.functions.bind import bind, words
from textlots.functions.rules import best_rule, rule_attr, scores
from textlots.functions.text import amount_hint, date_hint
from textlots.packs import PACKS, Pack

HINTS = {"amount_hint": amount_hint, "date_hint": date_hint}


def with_rule(df: DataFrame, pack: Pack, text: str = "text", out: str = "rule") -> DataFrame:
    """Position of the winning rule (null: no keyword found)."""
    return df.withColumn(out, best_rule(F.col(text), pack))


def with_hints(df: DataFrame, pack: Pack, text: str = "text", rule: str = "rule") -> DataFrame:
    """Amount and date hints, only for packs that ask for them and rows that hit a rule."""
    wanted = hint_keys(pack)
    return df.withColumns({k: F.when(F.col(rule).isNotNull(), HINTS[k](F.col(text))) for k in wanted})


def hint_keys(pack: Pack) -> list[str]:
    return [k for k in pack.result_keys if k in HINTS]


def result_column(pack: Pack, key: str, rule: str = "rule") -> Column:
    return F.col(key) if key in HINTS else rule_attr(F.col(rule), pack, key)


def classification(pack: Pack, rule: str = "rule", method: str = "rules") -> Column:
    """The record of a row: the pack's keys, the method label and the match flag."""
    return F.struct(
        *[result_column(pack, key, rule).alias(key) for key in pack.result_keys],
        F.lit(method).alias("_method"),
        F.col(rule).isNotNull().alias("_matched"),
    )


def classify(df: DataFrame, pack: Pack, text: str = "text", method: str = "rules") -> DataFrame:
    """Add the struct ``classification``."""
    ruled = with_hints(with_rule(df, pack, text, "_rule"), pack, text, "_rule")
    labelled = ruled.withColumn("classification", classification(pack, "_rule", method))
    return labelled.drop("_rule", *hint_keys(pack))


def match_rules(df: DataFrame, pack: Pack, text: str = "text") -> DataFrame:
    """Long form: a row per text and rule that it hits, with the number of keywords."""
    found = bind(F.lower(F.col(text)), lambda lowered: scores(lowered, pack))
    hits = F.arrays_zip(words(rule.type for rule in pack.rules).alias("type"), found.alias("hits"))
    kept = [c for c in df.columns if c != text]
    matched = df.select(*kept, F.explode(F.filter(hits, lambda pair: pair["hits"] > 0)).alias("_m"))
    return matched.select(*kept, F.col("_m")["type"].alias("type"), F.col("_m")["hits"].alias("hits"))


def rules_from_table(table: DataFrame, domain: str, keys: Sequence[str]) -> DataFrame:
    """A pack kept as a table ``rule_order, type, keyword, attrs``: one row with its ordered rules.

    A type is one rule; it takes the place and the attributes of its first row. Rules of the
    same order go by type.
    """
    first = F.min(F.struct("rule_order", *[F.col("attrs")[key].alias(key) for key in keys]))
    rules = (
        table.where((F.col("domain") == domain) & F.col("keyword").isNotNull())
        .groupBy("type")
        .agg(first.alias("first"), F.array_sort(F.collect_set(F.lower("keyword"))).alias("keywords"))
    )
    rule = F.struct(
        F.col("first.rule_order").alias("rule_order"), "type", "keywords",
        F.struct(*[F.col(f"first.{key}").alias(key) for key in keys]).alias("attrs"),
    )
    return rules.agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def classify_by_table(
    df: DataFrame, table: DataFrame, domain: str, type_key: str, fallback: dict[str, str], text: str = "text",
    method: str = "rules",
) -> DataFrame:
    """Add the struct ``classification`` by a pack that is kept as a table.

    The ordered rules are one value, computed by Spark and given to every task; a pack may
    hold any number of keywords.
    """
    keys = [key for key in fallback if key != type_key]
    rules, low = F.col("_rules"), F.col("_lowered")
    ruled = df.withColumns(
        {"_rules": rules_from_table(table, domain, keys).scalar(), "_lowered": F.lower(F.col(text))}
    )
    counted = ruled.withColumn(
        "_counts",
        F.transform(rules, lambda rule: F.size(F.filter(rule["keywords"], lambda word: F.contains(low, word)))),
    ).withColumn("_best", F.array_max("_counts"))
    place = F.when(F.col("_best") > 0, F.array_position("_counts", F.col("_best")).cast("int") - 1)
    won = counted.withColumn("_rule", F.get(rules, place))
    record = F.struct(
        F.coalesce(F.col("_rule")["type"], F.lit(fallback[type_key])).alias(type_key),
        *[F.coalesce(F.col("_rule")["attrs"][key], F.lit(fallback[key])).alias(key) for key in keys],
        F.lit(method).alias("_method"),
        F.col("_rule").isNotNull().alias("_matched"),
    )
    return won.withColumn("classification", record).select(*df.columns, "classification")


def catalog(spark: SparkSession) -> DataFrame:
    """The packs on offer: id, label, description and result keys."""
    rows = [(p.domain, p.label, p.description, list(p.result_keys)) for p in PACKS.values()]
    return spark.createDataFrame(rows, "id string, label string, description string, result_keys array<string>")
