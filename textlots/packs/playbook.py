"""Support playbook: steps per module and reply wording."""

# Fixed values: (module, steps) in lookup order.
PLAYBOOK = (
    (
        "Carga/exportación de Excel",
        (
            "Comprueba que el archivo sea .xlsx o .csv (no .xls antiguo ni PDF renombrado).",
            "Si el archivo es muy grande, prueba con menos filas o divide el Excel en partes.",
            "Vuelve a subir el archivo y espera a que el job termine (no cierres la pestaña a mitad).",
            "Si falla al exportar, recarga la página e intenta de nuevo; el backend guarda el job un tiempo.",
            "Si el error continúa, indícanos el nombre del archivo y si falló al subir o al descargar.",
        ),
    ),
    (
        "Traducción de tokens",
        (
            "Confirma que el backend arrancó con el modelo CTranslate2/OPUS-MT (revisa el log de arranque).",
            "Si el modelo no está cargado, la app puede usar el camino de diccionario (menor calidad).",
            "Reinicia el backend tras cambiar modelos o variables de entorno.",
            "Prueba con un Excel pequeño de 5–10 filas para aislar el fallo.",
        ),
    ),
    (
        "Tokenización / conteo",
        (
            "El conteo usa tiktoken (o200k). Un archivo vacío o sin texto en la columna esperada da 0 tokens.",
            "Revisa que la columna de reseñas/texto no esté vacía o con solo espacios.",
            "Recarga la página y vuelve a procesar el mismo archivo.",
        ),
    ),
    (
        "Optimización de tokens",
        (
            "Desactiva y vuelve a activar la optimización para forzar un recálculo limpio.",
            "Prueba sin optimización: si el flujo base funciona, el fallo está en el paso de optimización.",
            "Archivos con mucho ruido (HTML, URLs) a veces reducen menos tokens de lo esperado; es normal.",
        ),
    ),
    (
        "Interfaz (botones)",
        (
            "Haz un refresco forzado (Ctrl+Shift+R / Cmd+Shift+R) por si el navegador cacheó JS antiguo.",
            "Prueba en una ventana de incógnito para descartar extensiones.",
            "Indica qué botón exacto y en qué página (#/, analítica, etc.).",
        ),
    ),
    (
        "Interfaz (UI)",
        (
            "Prueba otro navegador o una ventana de incógnito.",
            "Revisa el zoom del navegador (100%) y el ancho de la ventana.",
            "Si es un detalle visual, lo registramos como mejora de UX (prioridad baja).",
        ),
    ),
    (
        "Analítica / gráficas",
        (
            "La analítica necesita un proceso completado con tokens originales y optimizados.",
            "Sube y procesa un archivo primero; luego abre la vista de analítica.",
            "Si los números no cambian, usa «recalcular» o vuelve a procesar el dataset.",
        ),
    ),
    (
        "Rendimiento del backend",
        (
            "La primera carga del modelo de traducción puede tardar varios minutos.",
            "Evita enviar varios Excel grandes a la vez; procesa de uno en uno.",
            "Si hay timeout, reduce filas o reinicia el backend y vuelve a intentar.",
        ),
    ),
    (
        "Automatización de reportes",
        (
            "El canal de reportes depende de n8n activo y del webhook configurado en el backend.",
            "Sin N8N_WEBHOOK_URL el formulario puede quedar en modo demo (dry-run).",
            "Si no recibes este correo, revisa spam y que el workflow n8n esté Published/Active.",
        ),
    ),
    (
        "Clasificación por dominio",
        (
            "Revisa que el dominio/tipo de reseña esté soportado en la configuración de la app.",
            "Prueba con un dominio conocido (p. ej. el de la demo) y compara el resultado.",
        ),
    ),
    (
        "Clasificación de reseñas",
        (
            "Comprueba que la columna de texto de reseñas no esté vacía.",
            "Algunas reseñas muy cortas o solo emojis se clasifican con menor confianza.",
        ),
    ),
    (
        "IA local / Ollama",
        (
            "Ollama es opcional en el pipeline de reportes; la clasificación principal usa reglas.",
            "Si activaste IA local, confirma que Ollama escucha en el puerto configurado.",
        ),
    ),
    (
        "IA externa / Gemini",
        (
            "Las integraciones externas requieren API key y red; en demo preferimos reglas locales.",
            "Si falló una llamada externa, el flujo de reportes sigue con clasificación por reglas.",
        ),
    ),
    (
        "Sin clasificar",
        (
            "Describe el paso exacto donde falla (subir, procesar, exportar, analítica…).",
            "Si puedes, adjunta o copia el mensaje de error de la pantalla.",
            "Indica navegador y si ocurre siempre o solo con un archivo concreto.",
        ),
    ),
)

# Steps for modules without an entry.
GENERIC_STEPS = (
    "Recarga la página e intenta de nuevo el mismo flujo.",
    "Prueba con un archivo o acción más simple para aislar el fallo.",
    "Si el problema es bloqueante, responde a este correo con más detalle o un pantallazo.",
)

# Wording by severity (critica, baja, anything else).
INTRO_CRITICAL = (
    "Registramos tu reporte con prioridad alta. Mientras el equipo lo revisa, "
    "puedes probar estos pasos de mitigación:"
)
INTRO_LOW = (
    "Gracias por la sugerencia o el detalle. Lo tenemos anotado. "
    "Si te sirve de ayuda, aquí van algunas orientaciones relacionadas:"
)
INTRO_OTHER = "Recibimos tu reporte. Mientras lo revisamos, prueba estos pasos de solución:"
CLOSING_CRITICAL = (
    "Si sigue fallando tras estos pasos, no hace falta reintentar muchas veces: "
    "el equipo ya tiene el ticket."
)
CLOSING_LOW = (
    "No es un fallo crítico; lo priorizamos según impacto. Gracias por ayudarnos a mejorar {brand}."
)
CLOSING_OTHER = (
    "Si con estos pasos se resolvió, no necesitas hacer nada más. Si no, responde con el resultado."
)

# Subject and body of the reply; {brand} is the name of the product.
SUBJECT = "[{brand}] Guía de solución · "
SIGNATURE = (
    "— Equipo {brand}",
    "(Respuesta automática por plantillas; clasificación por reglas, sin IA generativa.)",
)
