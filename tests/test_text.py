"""Text functions against short Python statements of the rules."""

import random
import re
import unicodedata

from textlots.functions import text as tx
from textlots.functions.numbers import round_even

SPACES = ["\t", "\n", "\x0b", "\x1c", "\x1f", " ", "\x85", "\xa0", " ", " ", " ", " ", "　"]


def random_texts(seed, n=300):
    rng = random.Random(seed)
    parts = SPACES + list("abcXYZñÁé.,;:!?/-0123456789") + ["de", "la", " uno", "​", "ſ", "İ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_clean_and_strip_know_all_white_space(evaluate):
    texts = random_texts(1)
    assert evaluate(tx.clean, texts) == [re.sub(r"\s+", " ", t.strip()) for t in texts]
    assert evaluate(tx.strip, texts) == [t.strip() for t in texts]


def test_header_like(evaluate):
    def expected(text):
        words = text.split()
        return (
            not re.search(r"[,.;:!?]", text)
            and len(words) >= 2
            and max(map(len, words)) <= 12
            and not {w.lower() for w in words} & set(tx.STOPWORDS)
        )

    texts = [re.sub(r"\s+", " ", t.strip()) for t in random_texts(2)]
    texts += ["Nombre Correo Telefono", "Nombre de cliente", "una sola, coma", "palabra", "a" * 13 + " b"]
    assert evaluate(tx.header_like, texts) == [expected(t) for t in texts]


def test_junk_reason(evaluate):
    cells = ["ab", "12/05/2023", "corto", "Nombre Correo Telefono", "La app se cierra", None, "ñandú veloz sin punto, sí"]
    assert evaluate(tx.junk_reason, cells) == [
        "under_3_chars", "no_letter", "under_10_chars", "header_like", None, "no_value", None,
    ]


def test_normalize(evaluate):
    words = ["Reseña", "  DESCRIPCIÓN ", "Año", "éxito", "über", "plain"]

    def expected(word):
        letters = unicodedata.normalize("NFKD", word)
        return "".join(c for c in letters if not unicodedata.combining(c)).lower().strip()

    assert evaluate(tx.normalize, words) == [expected(w) for w in words]


def test_compress(evaluate):
    long_dot = "a" * 200 + ". " + "b" * 200
    early_dot = "a" * 100 + ". " + "b" * 300
    edge = "a" * 140 + "." + "b" * 300
    at_end = "a" * 279 + "." + "b" * 30
    assert evaluate(tx.compress, ["kurz", long_dot, early_dot, edge, at_end]) == [
        "kurz", "a" * 200 + ".", early_dot[:280] + "…", edge[:280] + "…", at_end[:280],
    ]


def test_summary_tries_separators_in_turn(evaluate):
    cases = {
        "Primera frase larga. Segunda": "Primera frase larga",
        "Corta. Otra parte\nfin": "Corta. Otra parte",
        "Ok. No": "Ok",
        "uno。dos tres cuatro cinco": "uno",
        "x" * 120: "x" * 97 + "…",
        "sin separador": "sin separador",
    }
    assert evaluate(tx.summary, list(cases)) == list(cases.values())


def test_hints(evaluate):
    cases = ["pago de $1.500,00 pesos", "en 2024", "sin cifra", "USD 300", "100 DÓLARES al mes"]
    assert evaluate(tx.amount_hint, cases) == ["$1.500,00 pesos", "202", None, "USD 300", "100 DÓLARES"]
    dates = ["el 12/05/2023.", "3 de marzo de 2025", "3 DE Ábril DE 2025", "a12/05/2023", "12-5-23x", "nada"]
    assert evaluate(tx.date_hint, dates) == ["12/05/2023", "3 de marzo de 2025", "3 DE Ábril DE 2025", None, None, None]


def test_html_escape(evaluate):
    assert evaluate(tx.html_escape, ['<a href="x">&amp;</a>']) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;amp;&lt;/a&gt;"
    ]


def test_dedup_key_ignores_case_and_outer_space(evaluate):
    a, b, c = evaluate(tx.dedup_key, ["  Hola Mundo ", "hola mundo\n", "hola  mundo"])
    assert a == b != c


def test_round_even_equals_python(evaluate):
    rng = random.Random(3)
    values = [2.675, 0.125, 2.5e-06, 7.5e-06, 1.005, -0.125, -2.675, 0.0, 12.25, 1e9 + 0.005]
    values += [rng.uniform(-1000, 1000) for _ in range(300)] + [rng.randint(0, 4000) / 8 for _ in range(100)]
    values += [rng.randint(0, 9999) / 1e6 * 2.5 for _ in range(300)]
    for digits in (1, 2, 3, 6):
        assert evaluate(lambda c: round_even(c, digits), values, "double") == [round(v, digits) for v in values]


def test_piece_count_makes_no_list_of_pieces(spark, evaluate):
    from pyspark.sql import functions as F

    texts = random_texts(5) + ["", " ", "\t\n", " a", "\x1c12345 ab,,c ", "12 3456", None]
    pattern = re.compile(r"[^\W\d_]+|\d{1,3}|[^ \t\n\x0b\f\r\w]+")
    assert evaluate(tx.piece_count, texts) == [len(pattern.findall(t or "")) for t in texts]
    plan = spark.createDataFrame([("a",)], "v string").select(tx.piece_count(F.col("v")))
    assert "regexp_extract_all" not in plan._jdf.queryExecution().optimizedPlan().toString()
