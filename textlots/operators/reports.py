"""Problem reports: validation, triage, replies. Same functions for batch and stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlots.functions.rules import first_module, severity
from textlots.functions.text import NOT_WS, UNICODE, strip, summary, summary_compact
from textlots.packs import playbook as book
from textlots.packs import triage as lists

Playbook = Sequence[tuple[str, Sequence[str]]]

# Limits of a report.
MIN_MESSAGE, MAX_MESSAGE = 10, 4_000
MAX_EMAIL, MAX_PAGE, MAX_AGENT = 254, 200, 300

_NO_AT = NOT_WS[:-1] + "@]"
EMAIL = rf"{UNICODE}^{_NO_AT}+@{_NO_AT}+\.{_NO_AT}+$"


def filled(c: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(c, F.lit(""))


def validate_reports(df: DataFrame) -> DataFrame:
    """Tidy message, email, page and agent; ``reject_reason`` is null for a good report."""
    raw = F.coalesce("mensaje", F.lit(""))
    email = filled(strip(F.col("email")))
    return (
        df.withColumn("_text", strip(raw))
        .withColumn(
            "reject_reason",
            F.when((F.length(raw) < MIN_MESSAGE) | (F.length("_text") < MIN_MESSAGE), "mensaje_too_short")
            .when(F.length(raw) > MAX_MESSAGE, "mensaje_too_long")
            .when(F.length("page") > MAX_PAGE, "page_too_long")
            .when((F.length(email) > MAX_EMAIL) | ~email.rlike(EMAIL), "email_invalid"),
        )
        .withColumn("mensaje", F.col("_text"))
        .withColumn("email", F.lower(email))
        .withColumn("page", F.coalesce("page", F.lit("")))
        .withColumn("user_agent", F.substring(F.coalesce("user_agent", F.lit("")), 1, MAX_AGENT))
        .drop("_text")
    )


def rejected_reports(df: DataFrame) -> DataFrame:
    """The reports that validation refuses, with the reason."""
    return validate_reports(df).where(F.col("reject_reason").isNotNull())


def triage(df: DataFrame, pack: str = "full", text: str = "mensaje") -> DataFrame:
    """Add severity, module, summary and the stripped text."""
    critical, low, modules = lists.PACKS[pack]
    shorten = summary if pack == "full" else summary_compact
    stripped = strip(F.coalesce(F.col(text), F.lit("")))
    return (
        df.withColumn("texto_original", stripped)
        .withColumn("_low", F.lower("texto_original"))
        .withColumn("severidad", severity(F.col("_low"), critical, low))
        .withColumn("modulo_probable", first_module(F.col("_low"), modules, lists.UNCLASSIFIED))
        .withColumn("resumen", shorten(F.col("texto_original")))
        .drop("_low")
    )


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*[filled(F.col(c) if isinstance(c, str) else c) for c in columns])


def unwrap_reports(df: DataFrame) -> DataFrame:
    """Inputs of the compact variant: each field flat or inside ``body``."""
    body = F.col("body")
    return df.select(
        "*",
        strip(
            F.coalesce(
                first_filled("mensaje", "texto_original", body["mensaje"], body["texto_original"]), F.lit("")
            )
        ).alias("_message"),
        F.lower(strip(F.coalesce(first_filled("email", body["email"]), F.lit("")))).alias("_email"),
        F.coalesce(first_filled("source", body["source"]), F.lit("webhook")).alias("_source"),
        F.coalesce(first_filled("timestamp", body["timestamp"]), iso_now()).alias("_timestamp"),
        F.coalesce(first_filled("page", body["page"]), F.lit("")).alias("_page"),
    )


def triage_compact(df: DataFrame, keep: Sequence[str] = ("report_id",)) -> DataFrame:
    """Triage with the compact lists on flat or nested input fields."""
    flat = unwrap_reports(df).select(
        *keep,
        F.col("_message").alias("mensaje"),
        F.col("_email").alias("email"),
        F.col("_source").alias("source"),
        F.col("_timestamp").alias("timestamp"),
        F.col("_page").alias("page"),
    )
    return triage(flat, "compact")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def iso_now() -> Column:
    return iso(F.current_timestamp())


def _json_text(df: DataFrame, name: str, column: Column | None = None) -> Column:
    """A string column as it is, an object as its JSON text."""
    column = F.col(name) if column is None else column
    return F.to_json(column) if df.schema[name].dataType.typeName() in ("struct", "map", "variant") else column


def parse_triage(df: DataFrame, col: str = "response") -> DataFrame:
    """Read a model's JSON answer; broken JSON and missing fields get defaults.

    Needs ``mensaje``, the text that was sent. Where the answer is null, ``message.content``
    is read, if the table has it. An answer that is an object already is taken as it is.
    All given columns stay, so the context of a report (source, timestamp) is kept.
    """
    given = [_json_text(df, col)]
    message_type = dict(df.dtypes).get("message", "")
    if message_type.startswith("struct") and "content" in df.schema["message"].dataType.names:
        given.append(_json_text(df.select("message.content"), "content", F.col("message.content")))
    raw = F.coalesce(*given, F.lit(""))
    parsed = df.withColumn("_json", F.try_parse_json(raw))
    # The parser stops after the first value; a value with anything behind it does not
    # survive being put inside both an array and an object.
    whole = [F.concat(F.lit(left), raw, F.lit(right)) for left, right in (("[", "]"), ('{"v":', "}"))]
    valid = (
        F.col("_json").isNotNull()
        & (F.schema_of_variant("_json") != "VOID")
        & F.try_parse_json(whole[0]).isNotNull()
        & F.try_parse_json(whole[1]).isNotNull()
    )

    def field(name: str) -> Column:
        return F.when(valid, filled(F.try_variant_get("_json", f"$.{name}", "string")))

    message = F.coalesce("mensaje", F.lit(""))
    original = F.when(valid, field("texto_original")).otherwise(filled(message))
    answer = F.when(valid, field("resumen")).otherwise(filled(F.substring(raw, 1, 120)))
    return (
        parsed.withColumn("severidad", F.coalesce(field("severidad"), F.lit("media")))
        .withColumn("modulo_probable", F.coalesce(field("modulo_probable"), F.lit(lists.UNCLASSIFIED)))
        .withColumn("resumen", F.coalesce(answer, F.substring(original, 1, 120), F.lit("")))
        .withColumn("texto_original", F.coalesce(original, message))
        .withColumn("via", F.lit("ollama"))
        .drop("_json")
    )


def _steps(steps: Sequence[str]) -> Column:
    return F.array(*[F.lit(step) for step in steps])


def with_playbook(
    df: DataFrame,
    playbook: Playbook = book.PLAYBOOK,
    generic: Sequence[str] = book.GENERIC_STEPS,
    module: str = "modulo_probable",
) -> DataFrame:
    """Add the support steps ``pasos`` and the entry ``playbook`` they come from.

    The exact entry wins, else the first whose name holds the module or is held by it.
    """
    key = strip(F.coalesce(F.col(module), F.lit("")))
    exact = reduce(
        lambda chain, name: chain.when(key == name, name),
        [name for name, _ in playbook],
        F.when(key == "", F.lit(None).cast("string")),
    )
    partial = reduce(
        lambda chain, name: chain.when(F.contains(F.lit(name), key) | F.contains(key, F.lit(name)), name),
        [name for name, _ in playbook],
        F.when(key == "", F.lit(None).cast("string")),
    )
    steps = F.create_map(*[part for name, texts in playbook for part in (F.lit(name), _steps(texts))])
    return df.withColumn("playbook", F.coalesce(exact, partial)).withColumn(
        "pasos", F.coalesce(F.element_at(steps, F.col("playbook")), _steps(generic))
    )


def by_severity(level: Column, critical: str, low: str, other: str) -> Column:
    return F.when(level == "critica", critical).when(level == "baja", low).otherwise(other)


def compose_reply(df: DataFrame, brand: str = "Soporte", **playbook: Playbook) -> DataFrame:
    """Reply by template: subject, body, steps and whether it can be sent.

    ``brand`` is the product named in subject, closing and signature.
    """
    prepared = with_playbook(
        df.withColumn("email_usuario", F.lower(strip(F.coalesce("email", F.lit("")))))
        .withColumn("severidad", F.coalesce(filled(F.col("severidad")), F.lit("media")))
        .withColumn(
            "modulo_probable", F.coalesce(filled(F.col("modulo_probable")), F.lit(lists.UNCLASSIFIED))
        ),
        **playbook,
    )
    level = F.lower("severidad")
    message = strip(F.coalesce(first_filled("texto_original", "mensaje"), F.lit("")))
    numbered = F.array_join(
        F.transform("pasos", lambda step, i: F.concat((i + 1).cast("string"), F.lit(". "), step)), "\n"
    )
    sent = F.contains("email_usuario", F.lit("@"))
    closing = by_severity(
        level, book.CLOSING_CRITICAL, book.CLOSING_LOW.format(brand=brand), book.CLOSING_OTHER
    )
    lines = [
        F.lit("Hola,"),
        F.lit(""),
        F.col("intro_auto"),
        F.lit(""),
        F.concat(F.lit("Módulo detectado: "), F.col("modulo_probable")),
        F.concat(F.lit("Severidad: "), F.col("severidad")),
        F.lit(""),
        F.lit("Tu mensaje:"),
        F.coalesce(filled(message), F.lit("—")),
        F.lit(""),
        F.lit("Pasos sugeridos:"),
        numbered,
        F.lit(""),
        F.col("cierre_auto"),
        F.lit(""),
        *[F.lit(line.format(brand=brand)) for line in book.SIGNATURE],
    ]
    return (
        prepared.withColumn("tiene_email", sent)
        .withColumn("intro_auto", by_severity(level, book.INTRO_CRITICAL, book.INTRO_LOW, book.INTRO_OTHER))
        .withColumn("cierre_auto", closing)
        .withColumn("asunto_auto", F.concat(F.lit(book.SUBJECT.format(brand=brand)), F.col("modulo_probable")))
        .withColumn("cuerpo_texto", F.concat_ws("\n", *lines))
        .withColumn("respuesta_auto", F.col("cuerpo_texto"))
        .withColumn("auto_reply_estado", F.when(sent, "pendiente_envio").otherwise("sin_email"))
    )


def tracker_rows(df: DataFrame) -> DataFrame:
    """The row that every good report leaves in the tracker."""
    return df.select(
        "report_id",
        F.col("timestamp").alias("fecha"),
        "severidad",
        F.col("modulo_probable").alias("modulo"),
        "resumen",
        "texto_original",
        "source",
    )


def alert_text(df: DataFrame, brand: str = "Soporte") -> DataFrame:
    """Alert message and mail subject of a triaged report."""
    text = F.concat(
        F.lit(f"🚨 {brand} CRÍTICO\nMódulo: "),
        F.col("modulo_probable"),
        F.lit("\nResumen: "),
        F.col("resumen"),
        F.lit("\n\n"),
        F.col("texto_original"),
    )
    subject = F.concat(
        F.lit(f"[{brand}]["), F.col("severidad"), F.lit("] "), F.col("modulo_probable")
    )
    return df.withColumn("alert_text", text).withColumn("mail_subject", subject)


def submit(df: DataFrame, source: str = "web") -> DataFrame:
    """Good reports, triaged, with channel and time: the event that leaves the form.

    ``ts`` is the time of arrival; where it is null, the time of the run counts.
    """
    good = validate_reports(df).where(F.col("reject_reason").isNull()).drop("reject_reason")
    return (
        triage(good)
        .withColumn("source", F.lit(source))
        .withColumn("timestamp", F.coalesce(iso(F.col("ts")), iso_now()))
        .withColumn("email", F.coalesce("email", F.lit("")))
        .drop("ts")
    )
