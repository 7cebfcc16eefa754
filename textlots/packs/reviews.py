"""Keyword rule pack: reviews."""

from textlots.packs.model import Pack, Rule

# The rule order, keywords, attributes and fallback decide the result.
REVIEWS = Pack(
    domain="reviews",
    label="Reseñas de apps",
    description="Clasifica fallas técnicas y feedback de App Store / Play Store.",
    type_key="error_type",
    result_keys=("error_type", "component", "severity", "sentiment", "summary"),
    fallback={
        "error_type": "other",
        "component": "general",
        "severity": "low",
        "sentiment": "neutral",
        "summary": "Unclassified feedback item.",
    },
    rules=(
        Rule(
            type="crash",
            keywords=(
                "se cierra", "crash", "se detiene", "sale de la app", "se cayo", "se cayó",
                "se cierra sola",
            ),
            attrs={
                "component": "app_core",
                "severity": "high",
                "sentiment": "negative",
                "summary": "App crashes unexpectedly during use.",
            },
        ),
        Rule(
            type="freeze",
            keywords=(
                "se congela", "no responde", "se queda", "congelada", "frozen",
            ),
            attrs={
                "component": "app_core",
                "severity": "high",
                "sentiment": "negative",
                "summary": "App freezes and stops responding.",
            },
        ),
        Rule(
            type="login_error",
            keywords=(
                "no puedo iniciar", "iniciar sesion", "iniciar sesión", "contrasena",
                "contraseña", "password", "login", "autenticacion", "autenticación",
                "credenciales",
            ),
            attrs={
                "component": "authentication",
                "severity": "critical",
                "sentiment": "negative",
                "summary": "User cannot sign in due to authentication failure.",
            },
        ),
        Rule(
            type="payment_error",
            keywords=(
                "pago", "cobro", "tarjeta", "suscripcion", "suscripción", "factura",
                "cobraron", "reembolso",
            ),
            attrs={
                "component": "billing",
                "severity": "critical",
                "sentiment": "negative",
                "summary": "Payment or billing issue reported.",
            },
        ),
        Rule(
            type="network_error",
            keywords=(
                "conexion", "conexión", "sin internet", "red", "servidor", "se pierde",
                "timeout", "offline",
            ),
            attrs={
                "component": "network",
                "severity": "high",
                "sentiment": "negative",
                "summary": "Network or server connectivity failure.",
            },
        ),
        Rule(
            type="ui_bug",
            keywords=(
                "boton", "botón", "menu", "menú", "interfaz", "no aparece", "desaparece",
                "se ve mal", "no muestra",
            ),
            attrs={
                "component": "ui",
                "severity": "medium",
                "sentiment": "negative",
                "summary": "UI element behaves incorrectly or disappears.",
            },
        ),
        Rule(
            type="performance_issue",
            keywords=(
                "lenta", "tarda", "lento", "borroso", "retraso", "pesada", "demora",
            ),
            attrs={
                "component": "performance",
                "severity": "medium",
                "sentiment": "negative",
                "summary": "App performance is slow or degraded.",
            },
        ),
        Rule(
            type="data_loss",
            keywords=(
                "se borro", "se borró", "perdi", "perdí", "datos", "informacion",
                "información", "notas", "desaparecieron",
            ),
            attrs={
                "component": "data",
                "severity": "critical",
                "sentiment": "negative",
                "summary": "User data was lost or disappeared.",
            },
        ),
        Rule(
            type="battery_drain",
            keywords=(
                "bateria", "batería", "drena", "consume", "duracion", "duración",
            ),
            attrs={
                "component": "power",
                "severity": "high",
                "sentiment": "negative",
                "summary": "App drains battery excessively.",
            },
        ),
        Rule(
            type="notification_bug",
            keywords=(
                "notificacion", "notificación", "no llega", "aviso", "alerta",
            ),
            attrs={
                "component": "notifications",
                "severity": "medium",
                "sentiment": "negative",
                "summary": "Notifications are not delivered correctly.",
            },
        ),
        Rule(
            type="feature_request",
            keywords=(
                "me gustaria", "me gustaría", "podrian", "podrían", "seria bueno",
                "sería bueno", "falta la opcion", "agregar", "necesito", "deberia tener",
                "debería tener",
            ),
            attrs={
                "component": "features",
                "severity": "low",
                "sentiment": "neutral",
                "summary": "User requests a new feature or improvement.",
            },
        ),
        Rule(
            type="positive_feedback",
            keywords=(
                "excelente", "muy buena", "genial", "increible", "increíble", "recomiendo",
                "me encanta", "perfecta", "facil de usar", "fácil de usar",
                "supero mis expectativas",
            ),
            attrs={
                "component": "general",
                "severity": "low",
                "sentiment": "positive",
                "summary": "User expresses satisfaction with the app.",
            },
        ),
    ),
)
