"""Keyword rule pack: incidents."""

from textlots.packs.model import Pack, Rule

# The rule order, keywords, attributes and fallback decide the result.
INCIDENTS = Pack(
    domain="incidents",
    label="Incidencias",
    description="Clasifica incidencias operativas / médicas / soporte.",
    type_key="incident_type",
    result_keys=("incident_type", "priority", "department", "summary"),
    fallback={
        "incident_type": "other",
        "priority": "low",
        "department": "general",
        "summary": "Unclassified incident.",
    },
    rules=(
        Rule(
            type="reschedule",
            keywords=(
                "reprogramar", "reprogramacion", "reprogramación", "cambiar cita",
                "otra fecha", "otro horario",
            ),
            attrs={
                "priority": "medium",
                "department": "scheduling",
                "summary": "Request to reschedule an appointment.",
            },
        ),
        Rule(
            type="cancel",
            keywords=(
                "cancelar", "cancelacion", "cancelación", "anular", "no podre", "no podré",
            ),
            attrs={
                "priority": "medium",
                "department": "scheduling",
                "summary": "Request to cancel an appointment.",
            },
        ),
        Rule(
            type="urgent_care",
            keywords=(
                "urgente", "emergencia", "dolor fuerte", "inmediato", "critico", "crítico",
            ),
            attrs={
                "priority": "critical",
                "department": "clinical",
                "summary": "Urgent care or emergency request.",
            },
        ),
        Rule(
            type="billing_dispute",
            keywords=(
                "factura", "cobro", "cobraron", "seguro", "pago", "reembolso",
            ),
            attrs={
                "priority": "high",
                "department": "billing",
                "summary": "Billing or insurance dispute.",
            },
        ),
        Rule(
            type="system_outage",
            keywords=(
                "sistema caido", "sistema caído", "no funciona", "error del sistema",
                "offline",
            ),
            attrs={
                "priority": "critical",
                "department": "it",
                "summary": "System outage or platform failure.",
            },
        ),
        Rule(
            type="info_request",
            keywords=(
                "consulta", "informacion", "información", "quiero saber",
                "horario de atencion", "horario de atención",
            ),
            attrs={
                "priority": "low",
                "department": "support",
                "summary": "General information request.",
            },
        ),
    ),
)
