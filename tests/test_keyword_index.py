"""Keywords found through the index against every keyword in every text."""

from __future__ import annotations

import random

import pytest

from textlots.operators import classify, keyword_index
from textlots.packs import REVIEWS
from textlots.plans import inputs

TABLE = "domain string, rule_order int, type string, keyword string"


def brute(texts, rules):
    """{(text, type): hits} over distinct lower-case keywords of each type."""
    words = {}
    for _, kind, word in rules:
        words.setdefault(kind, set()).add(word.lower())
    return {
        (i, kind): hits for i, text in texts if text is not None for kind, known in words.items()
        if (hits := sum(word in text.lower() for word in known))
    }


def matched(spark, texts, rules, **how):
    df = spark.createDataFrame([("l", "s", i, t) for i, t in texts], "batch_id string, source string, row_no long, text string")
    table = spark.createDataFrame([("d", *rule) for rule in rules] + [("other", 0, "x", "a"), ("d", 0, "x", None)], TABLE)
    return keyword_index.match_table(df.repartition(4), table, "d", **how)


@pytest.mark.parametrize("block", [100_000, 7])
def test_equals_every_keyword_in_every_text(spark, block):
    texts = [(0, "La app se cierra"), (1, ""), (2, None), (3, "ab"), (4, "ÑANDÚ 😀😀x"), (5, "a\nb c"), (6, "aaaa"), (7, "APP app")]
    rules = [(3, "crash", "App"), (1, "crash", "cierra"), (2, "odd", "ñandú"), (2, "odd", "😀x"), (5, "short", "a"), (5, "short", "ab"),
             (6, "both", "app"), (7, "line", "\nb"), (8, "none", "zzz"), (9, "run", "aaa"), (9, "run", "AAA"), (1, "all", "")]
    rows = matched(spark, texts, rules, block=block).collect()
    assert {(r.row_no, r.type): r.hits for r in rows} == brute(texts, rules)
    best = {r.row_no: (r.type, r.hits) for r in keyword_index.winners(matched(spark, texts, rules, block=block)).collect()}
    assert best[0] == ("crash", 2) and best[1] == ("all", 1) and best[5] == ("all", 1) and 2 not in best


def test_words_and_keywords_beyond_them(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("ab \t\u3000\u00a0é", k=rng.randint(0, 90)))) for i in range(40)]
    rules = [(n, f"t{n % 5}", "".join(rng.choices("ab \u3000é", k=rng.randint(0, 5)))) for n in range(60)]
    rules += [(n, f"t{n % 5}", rng.choice(texts)[1][3:70]) for n in range(9)]
    assert {(r.row_no, r.type): r.hits for r in matched(spark, texts, rules).collect()} == brute(texts, rules)


def test_no_text_travels(spark):
    df = spark.createDataFrame([("l", "s", 1, "some text")], "batch_id string, source string, row_no long, text string")
    filed = spark.createDataFrame([("som", "some")], "group string, keyword string")
    assert keyword_index.candidates(df, filed).columns == ["batch_id", "source", "row_no", "keyword"]


def test_fifty_thousand_keywords(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(50_000)]
    rules = [(i % 40, f"type{i % 40}", word) for i, word in enumerate(words)]
    texts = [(i, " ".join(rng.choices(words, k=12) + ["".join(rng.choices(letters, k=7)) for _ in range(20)])) for i in range(200)]
    df = spark.createDataFrame([("l", "s", i, t) for i, t in texts], "batch_id string, source string, row_no long, text string")
    table = spark.createDataFrame([("d", *rule) for rule in rules], TABLE)
    rows = keyword_index.match_table(df, table, "d").collect()
    assert {(r.row_no, r.type): r.hits for r in rows} == brute(texts, rules)
    # Few of the ten million pairs of a text and a keyword are looked at.
    filed = keyword_index.index(keyword_index.keywords_of(table, "d"), df)
    assert keyword_index.candidates(df, filed).count() < 0.01 * len(words) * len(texts)


def test_equals_the_rules_of_a_pack(spark, small):
    lots = inputs.feedback(spark, small)
    rules = [("reviews", n, rule.type, word) for n, rule in enumerate(REVIEWS.rules) for word in rule.keywords]
    found = keyword_index.match_table(lots, spark.createDataFrame(rules, TABLE), "reviews").drop("rule_order")
    wanted = classify.match_rules(lots, REVIEWS)
    key = ["batch_id", "source", "row_no", "type", "hits"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, wanted.select(key).collect()))
