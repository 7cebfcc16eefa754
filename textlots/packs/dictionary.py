"""Spanish to English replacement dictionary used by the text rewrite."""

# Phrases (Spanish, English), matched case-insensitively as substrings.
PHRASES = (
    ("cada vez que", "whenever"),
    ("iniciar sesion", "log in"),
    ("iniciar sesión", "log in"),
    ("por medio del presente documento", "hereby"),
    ("el arrendatario se obliga", "the tenant agrees"),
    ("el arrendador se obliga", "the landlord agrees"),
    ("clausula de penalizacion", "penalty clause"),
    ("cláusula de penalización", "penalty clause"),
    ("fecha de vencimiento", "expiration date"),
    ("se cierra sola", "closes itself"),
    ("se cierra inesperadamente", "closes unexpectedly"),
    ("no puedo iniciar", "cannot start"),
    ("sin internet", "offline"),
    ("proxima semana", "next week"),
    ("próxima semana", "next week"),
    ("cita medica", "medical appointment"),
    ("cita médica", "medical appointment"),
    ("me gustaria", "I would like"),
    ("me gustaría", "I would like"),
    ("seria bueno", "it would be good"),
    ("sería bueno", "it would be good"),
    ("falta la opcion", "missing the option"),
    ("muy buena", "very good"),
    ("facil de usar", "easy to use"),
    ("fácil de usar", "easy to use"),
    ("dos veces", "twice"),
    ("se congela", "freezes"),
    ("no responde", "does not respond"),
    ("se pierde", "is lost"),
    ("no aparece", "does not appear"),
    ("se ve mal", "looks wrong"),
    ("no muestra", "does not show"),
    ("se borro", "was deleted"),
    ("se borró", "was deleted"),
    ("no llega", "does not arrive"),
)

# Single words (Spanish, English).
WORDS = (
    ("aplicacion", "application"),
    ("aplicación", "application"),
    ("cierra", "closes"),
    ("inesperadamente", "unexpectedly"),
    ("intento", "try"),
    ("subir", "upload"),
    ("foto", "photo"),
    ("perfil", "profile"),
    ("galeria", "gallery"),
    ("galería", "gallery"),
    ("telefono", "phone"),
    ("teléfono", "phone"),
    ("desde", "from"),
    ("error", "error"),
    ("contraseña", "password"),
    ("contrasena", "password"),
    ("incorrecta", "incorrect"),
    ("minutos", "minutes"),
    ("pagar", "pay"),
    ("suscripcion", "subscription"),
    ("suscripción", "subscription"),
    ("tarjeta", "card"),
    ("cobro", "charge"),
    ("actualizacion", "update"),
    ("actualización", "update"),
    ("congelada", "frozen"),
    ("abrir", "open"),
    ("cierre", "close"),
    ("video", "video"),
    ("borroso", "blurry"),
    ("retraso", "delay"),
    ("personas", "people"),
    ("videollamada", "video call"),
    ("puedo", "can"),
    ("conexion", "connection"),
    ("conexión", "connection"),
    ("estable", "stable"),
    ("carga", "loading"),
    ("nunca", "never"),
    ("cargar", "load"),
    ("botones", "buttons"),
    ("desaparecen", "disappear"),
    ("navegar", "navigate"),
    ("horizontal", "landscape"),
    ("vertical", "portrait"),
    ("menu", "menu"),
    ("menú", "menu"),
    ("notas", "notes"),
    ("guardadas", "saved"),
    ("reinstalar", "reinstall"),
    ("respaldo", "backup"),
    ("deseo", "I wish"),
    ("solicitar", "request"),
    ("reprogramacion", "rescheduling"),
    ("reprogramación", "rescheduling"),
    ("reprogramar", "reschedule"),
    ("horario", "schedule"),
    ("manana", "morning"),
    ("mañana", "morning"),
    ("cardiologo", "cardiologist"),
    ("cardiólogo", "cardiologist"),
    ("reunion", "meeting"),
    ("reunión", "meeting"),
    ("cancelar", "cancel"),
    ("confirmar", "confirm"),
    ("turno", "appointment"),
    ("especialidad", "specialty"),
    ("medico", "doctor"),
    ("médico", "doctor"),
    ("atencion", "care"),
    ("atención", "care"),
    ("consulta", "consultation"),
    ("paciente", "patient"),
    ("urgente", "urgent"),
    ("arrendamiento", "lease"),
    ("arrendatario", "tenant"),
    ("arrendador", "landlord"),
    ("clausula", "clause"),
    ("cláusula", "clause"),
    ("penalizacion", "penalty"),
    ("penalización", "penalty"),
    ("vencimiento", "expiration"),
    ("monto", "amount"),
    ("pago", "payment"),
    ("incumplimiento", "breach"),
    ("deposito", "deposit"),
    ("depósito", "deposit"),
    ("reseña", "review"),
    ("resena", "review"),
    ("comentario", "comment"),
    ("problema", "problem"),
    ("falla", "failure"),
    ("bug", "bug"),
    ("lenta", "slow"),
    ("lento", "slow"),
    ("tarda", "takes long"),
    ("excelente", "excellent"),
    ("genial", "great"),
    ("increible", "amazing"),
    ("increíble", "amazing"),
    ("recomiendo", "I recommend"),
    ("incidencia", "incident"),
    ("descripcion", "description"),
    ("descripción", "description"),
)
