"""Rule packs, triage, replies and reports."""

import random

from pyspark.sql import functions as F

from textlots.operators import classify as cl
from textlots.operators import reports
from textlots.packs import CONTRACTS, INCIDENTS, PACKS, REVIEWS, get_pack
from textlots.packs import triage as lists


def test_packs_have_the_published_sizes():
    sizes = {name: (len(p.rules), sum(len(r.keywords) for r in p.rules)) for name, p in PACKS.items()}
    assert sizes == {"reviews": (12, 96), "contracts": (6, 37), "incidents": (6, 35)}
    assert get_pack("unknown") is REVIEWS


def best(text, pack):
    scores = [sum(k in text.lower() for k in r.keywords) for r in pack.rules]
    return pack.rules[scores.index(max(scores))].type if max(scores) else pack.fallback[pack.type_key]


def test_classify_equals_the_rule(spark):
    rng = random.Random(7)
    for pack in PACKS.values():
        words = [k for r in pack.rules for k in r.keywords] + ["nada", "texto", "x"]
        texts = [" ".join(rng.choice(words).upper() for _ in range(rng.randint(0, 5))) for _ in range(200)]
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
        done = cl.classify(rows, pack).select("text", f"classification.{pack.type_key}", "classification._matched")
        for text, kind, matched in done.collect():
            assert kind == best(text, pack)
            assert matched == any(k in text.lower() for r in pack.rules for k in r.keywords)


def test_example_row(spark):
    row = cl.classify(spark.createDataFrame([("La app se cierra…",)], "text string"), REVIEWS).first()
    assert row.classification.asDict() == {
        "error_type": "crash", "component": "app_core", "severity": "high", "sentiment": "negative",
        "summary": "App crashes unexpectedly during use.", "_method": "rules", "_matched": True,
    }


def test_ties_go_to_the_earlier_rule_and_hints_need_a_match(spark):
    rows = spark.createDataFrame([("pago y crash",), ("el 1/1/2020 son 30",), ("renta 30 USD el 1/1/2020",)], "text string")
    kinds = [r.classification.error_type for r in cl.classify(rows, REVIEWS).collect()]
    assert kinds[0] == "crash"
    hints = [(r.classification.amount_hint, r.classification.date_hint) for r in cl.classify(rows, CONTRACTS).collect()]
    assert hints == [(None, None), (None, None), ("30 USD", "1/1/2020")]


def test_table_pack(spark):
    high = {"severity": "high"}
    table = spark.createDataFrame(
        [("d", 2, "b", "xx", high), ("d", 1, "a", "X", {}), ("d", 2, "b", "yy", high), ("d", 2, "aa", "zz", {}),
         ("d", 3, "b", "zz", {}), ("other", 0, "c", "q", {}), ("d", 4, "e", None, {})],
        "domain string, rule_order int, type string, keyword string, attrs map<string,string>",
    )
    rows = spark.createDataFrame([("x",), ("xx YY",), ("q",), ("zz",), (None,)], "text string")
    done = cl.classify_by_table(rows, table, "d", "kind", {"kind": "none", "severity": "low"})
    got = done.select("classification.kind", "classification.severity", "classification._matched").collect()
    assert [tuple(r) for r in got] == [
        ("a", "low", True), ("b", "high", True), ("none", "low", False), ("aa", "low", True), ("none", "low", False)
    ]
    large = spark.range(7000).selectExpr(
        "'d' AS domain", "cast(id AS int) AS rule_order", "'t' || id AS type", "'word' || id || '.' AS keyword",
        "map('severity', 'high') AS attrs",
    )
    last = cl.classify_by_table(rows.limit(1).selectExpr("'a word6999. here' AS text"), large, "d", "kind", {"kind": "none", "severity": "low"})
    assert last.first().classification.kind == "t6999"


def test_rules_of_one_type_count_together(spark):
    from dataclasses import replace

    from textlots.operators.costs import type_distribution
    from textlots.packs import Rule

    other = Rule(REVIEWS.fallback[REVIEWS.type_key], ("zzz",), REVIEWS.rules[0].attrs)
    pack = replace(REVIEWS, rules=(*REVIEWS.rules, other))
    canon = spark.createDataFrame([("l", len(pack.rules), 1), ("l", None, 2)], "batch_id string, rule int, n_rows long")
    assert [tuple(r) for r in type_distribution(canon, pack).collect()] == [("l", other.type, 3)]


def test_catalog(spark):
    assert [r.id for r in cl.catalog(spark).collect()] == ["reviews", "contracts", "incidents"]
    assert INCIDENTS.result_keys[0] == INCIDENTS.type_key


def triage_of(text, pack):
    critical, low, modules = lists.PACKS[pack]
    lowered = text.strip().lower()
    level = "critica" if any(k in lowered for k in critical) else "baja" if any(k in lowered for k in low) else "media"
    return level, next((name for word, name in modules if word in lowered), lists.UNCLASSIFIED)


def test_triage_equals_the_rule(spark):
    rng = random.Random(8)
    words = [*lists.CRITICAL, *lists.LOW, *(w for w, _ in lists.MODULES), "nada", "otro"]
    texts = [" ".join(rng.choice(words).title() for _ in range(rng.randint(0, 3))) for _ in range(300)]
    texts.append("El excel no carga y la app se cierra al exportar")
    rows = spark.createDataFrame([(t,) for t in texts], "mensaje string")
    for pack in ("full", "compact"):
        for row in reports.triage(rows, pack).collect():
            assert (row.severidad, row.modulo_probable) == triage_of(row.mensaje, pack)
    assert triage_of(texts[-1], "full") == ("critica", "Carga/exportación de Excel")


REPORT = "report_id int, mensaje string, email string, page string, user_agent string, ts timestamp"


def test_validation(spark):
    rows = [
        (1, "  corto   ", None, None, None, None),
        (2, "x" * 4001, None, None, None, None),
        (3, "mensaje correcto", " A@B.co ", None, "u" * 400, None),
        (4, "mensaje correcto", "a@b", None, None, None),
        (5, "mensaje correcto", "a b@c.de", None, None, None),
        (6, "mensaje correcto", "  ", "p" * 201, None, None),
        (7, "mensaje correcto", "e" * 250 + "@b.co", None, None, None),
    ]
    done = {r.report_id: r for r in reports.validate_reports(spark.createDataFrame(rows, REPORT)).collect()}
    assert [done[i].reject_reason for i in range(1, 8)] == [
        "mensaje_too_short", "mensaje_too_long", None, "email_invalid", "email_invalid", "page_too_long", "email_invalid",
    ]
    assert done[3].email == "a@b.co" and len(done[3].user_agent) == 300 and done[3].page == ""
    assert done[6].email is None


def test_model_answers(spark):
    rows = [
        ("m1", '{"severidad":"baja","modulo_probable":"X","resumen":"r","texto_original":"t"}'),
        ("m2", "no es json " + "y" * 200),
        ("m3", '{"severidad":"","texto_original":"' + "z" * 200 + '"}'),
        ("m4", "{}"),
        ("m5", ""),
        ("m6", None),
        ("m7", "null"),
        ("m8", '{"a":1} sobra'),
        ("m9", "{'severidad':'baja'}"),
    ]
    parsed = reports.parse_triage(spark.createDataFrame(rows, "mensaje string, response string")).collect()
    got = {r.mensaje: (r.severidad, r.modulo_probable, r.resumen, r.texto_original) for r in parsed}
    none = lists.UNCLASSIFIED
    assert got["m1"] == ("baja", "X", "r", "t")
    assert got["m2"] == ("media", none, rows[1][1][:120], "m2")
    assert got["m3"] == ("media", none, "z" * 120, "z" * 200)
    assert got["m4"] == ("media", none, "", "m4")
    assert got["m5"] == ("media", none, "m5", "m5")
    assert got["m6"] == ("media", none, "m6", "m6")
    assert got["m8"] == ("media", none, '{"a":1} sobra', "m8")
    assert got["m9"] == ("media", none, "{'severidad':'baja'}", "m9")


def test_triage_answers_in_other_places(spark):
    rows = [("m1", None, ('{"severidad":"baja","modulo_probable":"X"}',), "web"), ("m2", "", ('{"severidad":"baja"}',), "app")]
    df = spark.createDataFrame(rows, "mensaje string, response string, message struct<content:string>, source string")
    got = {r.mensaje: (r.severidad, r.modulo_probable, r.source) for r in reports.parse_triage(df).collect()}
    assert got == {"m1": ("baja", "X", "web"), "m2": ("media", lists.UNCLASSIFIED, "app")}
    object_answer = spark.createDataFrame([("m", ("alta", None))], "mensaje string, response struct<severidad:string,resumen:string>")
    row = reports.parse_triage(object_answer).first()
    assert (row.severidad, row.resumen, row.via) == ("alta", "", "ollama")


def test_playbook_and_reply(spark):
    rows = [
        (1, "Interfaz (UI)", "critica", "A@b.c", "no abre"),
        (2, "Autenticación", "baja", "", ""),
        (3, "Interfaz", "media", None, "hola"),
        (4, "x Traducción de tokens y", "media", "sinarroba", "hola"),
        (5, None, None, "a@b", "hola"),
    ]
    df = spark.createDataFrame(rows, "id int, modulo_probable string, severidad string, email string, mensaje string")
    df = df.withColumn("texto_original", F.col("mensaje"))
    done = {r.id: r for r in reports.compose_reply(df, brand="Producto").collect()}
    assert [done[i].playbook for i in range(1, 6)] == [
        "Interfaz (UI)", None, "Interfaz (botones)", "Traducción de tokens", "Sin clasificar",
    ]
    assert [len(done[i].pasos) for i in range(1, 6)] == [3, 3, 3, 4, 3]
    assert done[1].tiene_email and done[1].auto_reply_estado == "pendiente_envio"
    assert not done[4].tiene_email and done[4].auto_reply_estado == "sin_email"
    assert done[1].asunto_auto == "[Producto] Guía de solución · Interfaz (UI)"
    assert done[1].cuerpo_texto.split("\n")[7:9] == ["Tu mensaje:", "no abre"]
    assert "\n1. Prueba otro navegador o una ventana de incógnito.\n2. " in done[1].cuerpo_texto
    assert done[2].cuerpo_texto.split("\n")[8] == "—" and "mejorar Producto." in done[2].cuerpo_texto
    assert "Severidad: media" in done[5].cuerpo_texto


def test_compact_inputs(spark):
    rows = [
        (1, "", "desde texto. Y algo más", None, None, None, None, None, None),
        (2, None, None, " A@B.C ", "s", "2024", "p", "en el cuerpo, el excel no carga", None),
        (3, None, None, None, None, None, None, None, "solo original"),
    ]
    df = spark.createDataFrame(
        rows,
        "report_id int, mensaje string, texto_original string, email string, source string, timestamp string,"
        " page string, bm string, bt string",
    )
    none = F.lit(None).cast("string")
    body = F.struct(
        F.col("bm").alias("mensaje"), F.col("bt").alias("texto_original"), none.alias("email"),
        none.alias("source"), F.lit("t").alias("timestamp"), none.alias("page"),
    )
    done = {r.report_id: r for r in reports.triage_compact(df.withColumn("body", body)).collect()}
    assert done[1].mensaje == "desde texto. Y algo más" and done[1].resumen == "desde texto. Y algo más"
    assert done[1].source == "webhook" and done[1].timestamp == "t"
    assert done[2].severidad == "critica" and done[2].email == "a@b.c" and done[2].source == "s"
    assert done[3].mensaje == "solo original"


def test_a_text_is_scanned_once_for_all_keywords(spark, evaluate):
    import random

    from pyspark.sql import functions as F

    from textlots.functions import rules
    from textlots.packs.model import Pack, Rule

    rng = random.Random(4)
    for shortest in (1, 2, 3):
        keywords = ["".join(rng.choice("abñ ") for _ in range(rng.randint(shortest, 6))) for _ in range(24)]
        listed = tuple(Rule(str(i), tuple(keywords[i::4]), {}) for i in range(4))
        pack = Pack("d", "l", "d", "type", ("type",), {"type": "none"}, listed)
        texts = ["".join(rng.choice("abñ c𝒳\n") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", None]
        counts = [t and [sum(k in t for k in rule.keywords) for rule in listed] for t in texts]
        assert evaluate(lambda c: rules.scores(c, pack), texts) == [n if n and any(n) else None for n in counts]
    plan = spark.createDataFrame([("a",)], "v string").select(rules.scores(F.col("v"), pack))
    assert "RLIKE" not in plan._jdf.queryExecution().optimizedPlan().toString()
