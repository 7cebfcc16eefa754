"""Dictionary rewrite, rewrite hook and token counts."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from textlots.functions.keywords import any_of
from textlots.functions.rewrite import LETTERS, dict_rewrite, replace_phrases
from textlots.operators.rewrite import rewrite_with
from textlots.operators.tokens import with_tokens
from textlots.packs.dictionary import PHRASES, WORDS


def plain(word):
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def say(text, phrases=PHRASES, words=WORDS):
    """The rule in plain Python."""
    for spanish, english in sorted(phrases, key=lambda p: -len(p[0])):
        text = re.sub(re.escape(spanish), english, text, flags=re.I)
    known = dict(words)

    def one(match):
        word = match.group()
        found = known.get(word.lower()) or known.get(plain(word.lower()))
        if not found:
            return word
        if word.isupper():
            return found.upper()
        return found[0].upper() + found[1:] if word[0].isupper() else found

    return " ".join(re.sub(f"[{LETTERS}]+", one, text).split())


def random_texts(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [s for s, _ in PHRASES] + [s for s, _ in WORDS]
    vocabulary += ["hola", "perfíl", "ménu", "xpago", "pagos", ",", "ß", "ſ", "K", "ı", "\x01", "the", "l", "$1"]
    shapes = [str, str.upper, str.capitalize, str.swapcase]
    texts = []
    for _ in range(n):
        picked = [rng.choice(shapes)(rng.choice(vocabulary)) for _ in range(rng.randint(0, 9))]
        texts.append(rng.choice([" ", "", "  "]).join(picked))
    return texts


def test_rewrite_equals_the_rule(evaluate):
    texts = random_texts(5)
    assert evaluate(dict_rewrite, texts) == [say(t) for t in texts]


def test_a_replacement_may_complete_a_later_phrase(evaluate):
    phrases = (("aaaa", "b"), ("bcc", "d"), ("dd", "aaaa"))
    texts = ["aaaacc", "aaaaccaaaacc", "dd", "bccd", "none", "BCCbcc"]
    expected = [say(t, phrases, ()) for t in texts]
    assert evaluate(lambda c: replace_phrases(c, phrases), texts) == expected


def test_any_of_finds_the_longest_word():
    words = ["se cierra", "se cierra sola", "se cae", "red", "rojo", "alto", "bajo", "casa", "dado", "el", "foco"]
    pattern = re.compile(any_of(words))
    assert pattern.findall("se cierra sola, se cierra; red alto foco el") == [
        "se cierra sola", "se cierra", "red", "alto", "foco", "el",
    ]
    for word in words:
        assert pattern.fullmatch(word)


def test_rewrite_with_batches_and_fallback(spark):
    rows = spark.createDataFrame([(1, "hola pago"), (2, "  "), (3, None), (4, "vacío")], "id int, text string")

    def shout(texts):
        return ["" if t == "vacío" else t.upper() for t in texts]

    done = {r.id: (r.text_optimized, r.optimize_method) for r in rewrite_with(rows, "text", shout).collect()}
    assert done == {
        1: ("HOLA PAGO", "ctranslate2"), 2: ("  ", "ctranslate2"), 3: ("", "ctranslate2"), 4: ("vacío", "ctranslate2"),
    }

    def broken(texts):
        raise RuntimeError("engine is gone")

    one = rows.where("id = 1")
    assert rewrite_with(one, "text", broken).first()["text_optimized"] == "hola payment"
    assert rewrite_with(one, "text", broken).first()["optimize_method"] == "dictionary"
    passed = rewrite_with(one, "text", broken, fallback=False).first()
    assert (passed["text_optimized"], passed["optimize_method"]) == ("hola pago", "passthrough")


def test_only_the_texts_that_fail_alone_fall_back(spark):
    def picky(texts):
        if any("mal" in t for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(i, "mal pago" if i == 7 else f"texto {i}") for i in range(20)], "id int, text string")
    done = {r.id: (r.text_optimized, r.optimize_method) for r in rewrite_with(rows.coalesce(1), "text", picky).collect()}
    assert done.pop(7) == ("mal payment", "dictionary")
    assert done == {i: (f"TEXTO {i}", "ctranslate2") for i in range(20) if i != 7}


def test_native_tokens(spark):
    rows = spark.createDataFrame([("La app, 12345!",), ("",), (None,)], "text string")
    assert [r.n for r in with_tokens(rows, "text", "n").collect()] == [6, 0, 0]
