"""Keyword rules as expressions over lower-cased text.

Keyword lists are array literals walked by higher-order functions: hundreds of separate
``contains`` calls would make generated methods too large to compile.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlots.functions.bind import bind, words
from textlots.functions.keywords import any_of, every_place
from textlots.packs.model import Pack


def any_hit(lowered: Column, keywords: Iterable[str]) -> Column:
    return F.exists(words(keywords), lambda word: F.contains(lowered, word))


def scores(lowered: Column, pack: Pack) -> Column:
    """Per rule, how many of its keywords occur in the text; null if none does."""
    rules = F.array(*[words(k.lower() for k in rule.keywords) for rule in pack.rules])
    place = every_place(k.lower() for rule in pack.rules for k in rule.keywords)
    # One scan reads the text. The longest keyword at a place stands for the shorter ones it
    # begins with, and no keyword holds a line break, so counts come from these few pieces.
    longest = F.array_distinct(F.regexp_extract_all(lowered, F.lit(place), F.lit(1)))

    def counts(pieces: Column) -> Column:
        return F.transform(rules, lambda keywords: F.size(F.filter(keywords, lambda word: F.contains(pieces, word))))

    return bind(longest, lambda found: F.when(F.size(found) > 0, bind(F.array_join(found, "\n"), counts)))


def best_rule(text: Column, pack: Pack) -> Column:
    """1-based position of the first rule with the highest score, null if no keyword occurs."""

    def first_best(found: Column) -> Column:
        return F.array_position(found, F.array_max(found)).cast("int")

    return bind(F.lower(text), lambda lowered: bind(scores(lowered, pack), first_best))


def rule_attr(position: Column, pack: Pack, key: str) -> Column:
    """Attribute of the winning rule, or of the fallback record."""
    if key == pack.type_key:
        values = [rule.type for rule in pack.rules]
    else:
        values = [rule.attrs[key] for rule in pack.rules]
    # get(), not element_at(): the latter takes a null position for the last element.
    return F.coalesce(F.get(words(values), position - 1), F.lit(pack.fallback[key]))


def severity(lowered: Column, critical: Iterable[str], low: Iterable[str]) -> Column:
    return (
        F.when(lowered.rlike(any_of(critical)), "critica")
        .when(lowered.rlike(any_of(low)), "baja")
        .otherwise("media")
    )


def first_module(lowered: Column, modules: Iterable[tuple[str, str]], default: str) -> Column:
    """Name beside the first substring that occurs in the text."""
    pairs = list(modules)
    known = words(word for word, _ in pairs)
    first = F.get(F.filter(known, lambda word: F.contains(lowered, word)), F.lit(0))
    name = F.get(words(name for _, name in pairs), (F.array_position(known, first) - 1).cast("int"))
    return F.coalesce(name, F.lit(default))
