"""License scans: a positional index of the rarest words of known license passages.

Documents tell how rare the words of the passages are: their inverse document frequency is
counted over the whole corpus. The index files each passage under its word of the highest
frequency weight, with the word's place in it. A file looks up each of its words that the
index holds; word and place give where the passage would have to begin. The passage's other
rare words must stand at the same relative position (the postings intersect), its mandatory
key phrases must be there word by word, and enough of its words altogether. So "mit", a
common word of German texts, never leads anywhere while "license" is rarer.

Everything happens in the row of a document, in arrays as long as its words: nothing is
shuffled but the counts of the passages' words, one row per word. Column expressions only.

Defined results: a null or empty text has no words, no labels and the score 0; texts of any
length are scanned whole; every row of repeated documents and ids gets its result; an empty
table gives an empty result; other columns of the input, whatever their names, are ignored.
Of equally rare words the first by code point is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlots.llm.decontaminate import words

RARE_WORDS = 3
# Part of a passage's words that must stand in their places.
MIN_SHARE = 0.75


@dataclass(frozen=True)
class Passage:
    """A license label, words that tell it, and the phrases in them that must not be missing."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def required(self) -> list[tuple[int, str]]:
        """Place and word of every word of the mandatory phrases; of a passage without, of all words."""
        found = []
        for phrase in self.phrases or (self.text,):
            own = phrase.split()
            start = next(i for i in range(len(self.words)) if self.words[i : i + len(own)] == own)
            found += [(start + i, word) for i, word in enumerate(own)]
        return found


# The phrases of the contract, then opening and notice passages of public licenses.
BASE = (
    Passage("mit", "under the mit license", base=True),
    Passage("apache-2", "apache license version 2", base=True),
    Passage("cc-by-nc", "cc by nc", base=True),
)
PASSAGES = (
    *BASE,
    Passage(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Passage("mit", "the mit license mit", ("the mit license",)),
    Passage(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        ("in compliance with the license", "apache org licenses license 2"),
    ),
    Passage("gpl-3", "gnu general public license version 3"),
    Passage("gpl-3", "gnu gpl version 3"),
    Passage("gpl-2", "gnu general public license version 2"),
    Passage(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    Passage("lgpl", "gnu lesser general public license"),
    Passage("agpl-3", "gnu affero general public license"),
    Passage(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Passage(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Passage(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice",
        ("with or without fee is hereby granted",),
    ),
    Passage(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
    Passage("cc0", "cc0 1 0 universal"),
    Passage("cc-by", "creative commons attribution 4 0 international"),
    Passage("cc-by-sa", "creative commons attribution sharealike"),
    Passage("cc-by-sa", "cc by sa"),
    Passage("cc-by-nc", "creative commons attribution noncommercial"),
    Passage("cc-by-nd", "creative commons attribution noderivatives"),
    Passage("epl-2", "eclipse public license v 2 0", ("eclipse public license",)),
)


def document_frequencies(docs: DataFrame, passages: tuple[Passage, ...] = PASSAGES) -> dict[str, int]:
    """In how many documents each word of the passages occurs; one row per word comes to the driver."""
    known = sorted({word for passage in passages for word in passage.words})
    own = F.array_distinct(F.filter(words(F.col("text")), lambda w: w.isin(known)))
    rows = docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {word: 0 for word in known} | {row.word: row.n for row in rows}


def rarest(passage: Passage, frequencies: dict[str, int], n: int = RARE_WORDS) -> list[tuple[int, str]]:
    """Place and word of the passage's words of the highest inverse document frequency, the rarest first."""
    ordered = sorted(set(passage.words), key=lambda word: (frequencies.get(word, 0), word))
    return [(passage.words.index(word), word) for word in ordered[:n]]


def _sought(found: list[tuple[int, str]]) -> Column:
    return F.array(*[F.struct(F.lit(place).alias("place"), F.lit(word).alias("word")) for place, word in found])


def _posting(passage: Passage, rare: list[tuple[int, str]]) -> Column:
    return F.struct(
        F.lit(passage.label).alias("label"),
        F.lit(passage.base).alias("base"),
        F.lit(rare[0][0]).alias("place"),
        _sought(rare).alias("rare"),
        _sought(passage.required()).alias("required"),
        F.array(*[F.lit(word) for word in passage.words]).alias("words"),
    )


def _in_place(document: Column, start: Column, sought: Column) -> Column:
    return F.forall(sought, lambda one: F.coalesce(F.get(document, start + one["place"]) == one["word"], F.lit(False)))


def _share(document: Column, start: Column, passage: Column) -> Column:
    there = F.filter(passage, lambda word, at: F.get(document, start + at) == word)
    return F.size(there).cast("double") / F.size(passage)


def scanned(docs: DataFrame, passages: tuple[Passage, ...] = PASSAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, n_words, found) of every document; found lists (label, base, start, share) in word order."""
    frequencies = document_frequencies(docs, passages)
    index: dict[str, list[Column]] = {}
    for passage in passages:
        rare = rarest(passage, frequencies)
        index.setdefault(rare[0][1], []).append(_posting(passage, rare))
    postings = F.create_map(*[part for word, own in index.items() for part in (F.lit(word), F.array(*own))])
    document = F.col("words")

    def candidates(at: Column) -> Column:
        """Passages filed under the word at a place, with their beginning."""
        return F.transform(
            F.element_at(postings, F.get(document, at)),
            lambda p: F.struct((at - p["place"]).alias("start"), p.alias("passage")),
        )

    def verified(one: Column) -> Column:
        passage = one["passage"]
        return _in_place(document, one["start"], passage["rare"]) & _in_place(document, one["start"], passage["required"])

    places = F.array_compact(F.transform(document, lambda word, at: F.when(word.isin(list(index)), at)))
    whole = F.filter(F.flatten(F.transform(F.col("places"), candidates)), verified)
    rated = F.transform(
        whole,
        lambda one: F.struct(
            one["passage"]["label"].alias("label"),
            one["passage"]["base"].alias("base"),
            one["start"].alias("start"),
            _share(document, one["start"], one["passage"]["words"]).alias("share"),
        ),
    )
    return (
        docs.select("doc_id", words(F.col("text")).alias("words"))
        .withColumn("places", places)
        .select(
            "doc_id",
            F.size("words").cast("bigint").alias("n_words"),
            F.filter(rated, lambda one: one["share"] >= min_share).alias("found"),
        )
    )


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda one: one["label"]))), ",")


def license_scan(docs: DataFrame, passages: tuple[Passage, ...] = PASSAGES) -> DataFrame:
    """Per document: words, places of the base phrases, labels, and the best share of a passage's words."""
    base = F.filter("found", lambda one: one["base"])
    rows = scanned(docs, passages).withColumn("base", base)
    starts = F.transform("base", lambda one: one["start"].cast("bigint"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"),
        _labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda one: one["share"])), F.lit(0.0)).alias("score"),
    )
