"""Keyword rule pack: contracts."""

from textlots.packs.model import Pack, Rule

# The rule order, keywords, attributes and fallback decide the result.
CONTRACTS = Pack(
    domain="contracts",
    label="Contratos de arrendamiento",
    description="Extrae cláusulas, montos, fechas y penalizaciones de textos legales.",
    type_key="clause_type",
    result_keys=("clause_type", "amount_hint", "date_hint", "severity", "summary"),
    fallback={
        "clause_type": "general",
        "severity": "low",
        "summary": "Unclassified contract clause.",
    },
    rules=(
        Rule(
            type="penalty",
            keywords=(
                "penalizacion", "penalización", "multa", "sancion", "sanción",
                "incumplimiento",
            ),
            attrs={
                "severity": "high",
                "summary": "Penalty or sanction clause.",
            },
        ),
        Rule(
            type="payment",
            keywords=(
                "renta", "canon", "pago mensual", "monto", "pesos", "usd", "deposito",
                "depósito",
            ),
            attrs={
                "severity": "high",
                "summary": "Payment or deposit obligation.",
            },
        ),
        Rule(
            type="termination",
            keywords=(
                "terminacion", "terminación", "rescision", "rescisión", "finalizacion",
                "finalización", "vencimiento",
            ),
            attrs={
                "severity": "medium",
                "summary": "Termination or expiration terms.",
            },
        ),
        Rule(
            type="maintenance",
            keywords=(
                "mantenimiento", "reparacion", "reparación", "danos", "daños", "desperfectos",
            ),
            attrs={
                "severity": "medium",
                "summary": "Maintenance and damage responsibility.",
            },
        ),
        Rule(
            type="use_restrictions",
            keywords=(
                "prohibido", "no podra", "no podrá", "uso exclusivo", "subarrendar",
                "mascotas",
            ),
            attrs={
                "severity": "medium",
                "summary": "Use restrictions or prohibitions.",
            },
        ),
        Rule(
            type="legal_boilerplate",
            keywords=(
                "por medio del presente", "en fe de lo cual", "comparecen", "otorgan",
            ),
            attrs={
                "severity": "low",
                "summary": "Legal boilerplate / ceremonial language.",
            },
        ),
    ),
)
