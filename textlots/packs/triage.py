"""Keyword lists for problem-report triage."""

# Any of these makes a report critical.
CRITICAL = (
    "no carga", "no funciona", "no sirve", "se cae", "se cierra", "se cerro", "se cerró",
    "se cierra sola", "cierra sola", "de golpe", "crash", "crashea", "error 500", "error 502",
    "error 503", "no responde", "pantalla en blanco", "pantalla blanca", "no abre",
    "no arranca", "perdi", "perdí", "se borro", "se borró", "se congela", "congelad",
    "timeout", "time out", "corrupto", "no exporta", "no descarga", "falla total", "imposible",
    "urgente", "roto", "rompe", "exception", "traceback", "500 internal",
)

# Critical list of the compact variant.
CRITICAL_COMPACT = (
    "no carga", "no funciona", "no sirve", "se cae", "se cierra", "se cerro", "se cerró",
    "se cierra sola", "cierra sola", "de golpe", "crash", "crashea", "error 500", "error 502",
    "error 503", "no responde", "pantalla en blanco", "pantalla blanca", "no abre",
    "no arranca", "perdi", "perdí", "se borro", "se borró", "se congela", "congelad",
    "timeout", "time out", "corrupto", "no exporta", "no descarga", "falla total", "imposible",
    "urgente", "roto", "rompe", "exception", "traceback",
)

# Otherwise any of these makes it low priority.
LOW = (
    "sugerencia", "seria bueno", "sería bueno", "estaria bien", "estaría bien", "detalle",
    "color", "estetica", "estética", "tipografia", "tipografía", "podria mejorar",
    "podría mejorar", "me gustaria", "me gustaría", "nice to have", "opcional", "cosmetico",
    "cosmético", "ux", "ui menor",
)

# Fixed values: (substring, module); the first hit names the module.
MODULES = (
    ("excel", "Carga/exportación de Excel"),
    ("xlsx", "Carga/exportación de Excel"),
    ("xls", "Carga/exportación de Excel"),
    ("csv", "Carga/exportación de Excel"),
    ("subir archivo", "Carga/exportación de Excel"),
    ("subir el", "Carga/exportación de Excel"),
    ("subir", "Carga/exportación de Excel"),
    ("export", "Carga/exportación de Excel"),
    ("descarg", "Carga/exportación de Excel"),
    ("hoja de calculo", "Carga/exportación de Excel"),
    ("hoja de cálculo", "Carga/exportación de Excel"),
    ("openpyxl", "Carga/exportación de Excel"),
    ("traduc", "Traducción de tokens"),
    ("ctranslate", "Traducción de tokens"),
    ("opus", "Traducción de tokens"),
    ("token", "Tokenización / conteo"),
    ("o200k", "Tokenización / conteo"),
    ("tiktoken", "Tokenización / conteo"),
    ("optimiz", "Optimización de tokens"),
    ("ahorro", "Analítica / ahorro"),
    ("boton", "Interfaz (botones)"),
    ("botón", "Interfaz (botones)"),
    ("toggle", "Interfaz (UI)"),
    ("interfaz", "Interfaz (UI)"),
    ("pantalla", "Interfaz (UI)"),
    ("footer", "Interfaz (UI)"),
    ("navbar", "Interfaz (UI)"),
    ("menu", "Interfaz (UI)"),
    ("menú", "Interfaz (UI)"),
    ("grafic", "Analítica / gráficas"),
    ("chart", "Analítica / gráficas"),
    ("dashboard", "Analítica / gráficas"),
    ("kpi", "Analítica / gráficas"),
    ("tarda", "Rendimiento del backend"),
    ("lento", "Rendimiento del backend"),
    ("demora", "Rendimiento del backend"),
    ("timeout", "Rendimiento del backend"),
    ("colg", "Rendimiento del backend"),
    ("freeze", "Rendimiento del backend"),
    ("memoria", "Rendimiento del backend"),
    ("cpu", "Rendimiento del backend"),
    ("correo", "Automatización de reportes"),
    ("email", "Automatización de reportes"),
    ("gmail", "Automatización de reportes"),
    ("telegram", "Automatización de reportes"),
    ("n8n", "Automatización de reportes"),
    ("webhook", "Automatización de reportes"),
    ("reporte", "Automatización de reportes"),
    ("dominio", "Clasificación por dominio"),
    ("reseña", "Clasificación de reseñas"),
    ("resena", "Clasificación de reseñas"),
    ("review", "Clasificación de reseñas"),
    ("incidenc", "Clasificación de incidencias"),
    ("contrato", "Clasificación de contratos"),
    ("login", "Autenticación"),
    ("sesion", "Autenticación"),
    ("sesión", "Autenticación"),
    ("password", "Autenticación"),
    ("contraseña", "Autenticación"),
    ("ollama", "IA local / Ollama"),
    ("gemini", "IA externa / Gemini"),
    ("llm", "IA / modelos"),
)

# Module list of the compact variant.
MODULES_COMPACT = (
    ("excel", "Carga/exportación de Excel"),
    ("xlsx", "Carga/exportación de Excel"),
    ("xls", "Carga/exportación de Excel"),
    ("csv", "Carga/exportación de Excel"),
    ("subir archivo", "Carga/exportación de Excel"),
    ("subir el", "Carga/exportación de Excel"),
    ("subir", "Carga/exportación de Excel"),
    ("export", "Carga/exportación de Excel"),
    ("descarg", "Carga/exportación de Excel"),
    ("hoja de calculo", "Carga/exportación de Excel"),
    ("hoja de cálculo", "Carga/exportación de Excel"),
    ("traduc", "Traducción de tokens"),
    ("ctranslate", "Traducción de tokens"),
    ("token", "Tokenización / conteo"),
    ("optimiz", "Optimización de tokens"),
    ("boton", "Interfaz (botones)"),
    ("botón", "Interfaz (botones)"),
    ("toggle", "Interfaz (UI)"),
    ("interfaz", "Interfaz (UI)"),
    ("footer", "Interfaz (UI)"),
    ("grafic", "Analítica / gráficas"),
    ("chart", "Analítica / gráficas"),
    ("tarda", "Rendimiento del backend"),
    ("lento", "Rendimiento del backend"),
    ("demora", "Rendimiento del backend"),
    ("timeout", "Rendimiento del backend"),
    ("correo", "Automatización de reportes"),
    ("email", "Automatización de reportes"),
    ("gmail", "Automatización de reportes"),
    ("n8n", "Automatización de reportes"),
    ("webhook", "Automatización de reportes"),
    ("dominio", "Clasificación por dominio"),
    ("reseña", "Clasificación de reseñas"),
    ("resena", "Clasificación de reseñas"),
    ("review", "Clasificación de reseñas"),
    ("ollama", "IA local / Ollama"),
    ("gemini", "IA externa / Gemini"),
)

UNCLASSIFIED = "Sin clasificar"
PACKS = {
    "full": (CRITICAL, LOW, MODULES),
    "compact": (CRITICAL_COMPACT, LOW, MODULES_COMPACT),
}
