"""Decomposition beside Python's own, for every character and for mixed texts."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from textlots.functions.folding import fold
from textlots.functions.text import normalize


def expected(text):
    letters = unicodedata.normalize("NFKD", text)
    return "".join(c for c in letters if not unicodedata.combining(c))


def test_every_character(spark):
    """All code points but surrogates, each between two letters; assigned or not."""
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    import pandas as pd

    table = pd.DataFrame({"code": codes})
    table["text"] = ["x" + chr(c) + "y" for c in codes]
    table["folded"] = [expected(t) for t in table.text]
    rows = spark.createDataFrame(table).repartition(8)
    wrong = rows.where(~fold(F.col("text")).eqNullSafe(F.col("folded"))).select("code").limit(20).collect()
    assert wrong == []


TEXTS = [
    "ﬁnal ﬂow", "Ｆｕｌｌ ｗｉｄｔｈ", "x² + ½", "ёлка й", "한국어 텍스트 값", "が゛ｶﾞ", "ǅ Ω Å", "İstanbul", "é́́ n̈",
    "  ends 　", "㍿㋿ﷺ", "𝔘𝔫𝔦 𝟙𝟚", "ΟΔΟΣ ὀδός", "", " ", "plain", "각각" * 50_000 + "½",
]


@pytest.mark.parametrize("at", range(len(TEXTS)))
def test_texts(evaluate, at):
    assert evaluate(fold, [TEXTS[at]]) == [expected(TEXTS[at])]
    assert evaluate(normalize, [TEXTS[at]]) == [expected(TEXTS[at]).lower().strip()]


def test_nulls_and_no_rows(evaluate, spark):
    assert evaluate(fold, [None, "é"]) == [None, "e"]
    assert spark.createDataFrame([], "v string").select(fold(F.col("v"))).collect() == []


def test_argument_is_computed_once(spark):
    rows = spark.createDataFrame([("é",)], "v string").select(normalize(F.reverse("v")).alias("out"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
