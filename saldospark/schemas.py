"""Schemas of the tables that the operators exchange, as DDL strings."""

LINEAS = "doc_id string, linea int, texto string"
CUENTAS = (
    "doc_id string, linea int, codigo string, nombre string, monto double, origen_columna string, "
    "es_total boolean, confianza_extraccion double"
)
CATALOGO = (
    "codigo_estandar string, nombre_estandar string, categoria string, tipo_estado string, naturaleza string, "
    "signo_normal smallint, es_deuda_financiera boolean, es_activo_liquido boolean, afecta_ebitda boolean, "
    "descripcion string, activo boolean"
)
DICCIONARIO = (
    "cuenta_original string, cuenta_normalizada string, codigo_estandar string, fuente string, validado_humano boolean, "
    "validado_por string, validado_en timestamp, frecuencia_uso int, activo boolean, creado_en timestamp, "
    "actualizado_en timestamp, seq long"
)
LOG_VALIDACIONES = (
    "cuenta_original string, codigo_sugerido string, codigo_validado string, metodo_sugerido string, "
    "confianza_sugerida decimal(4,3), fue_correccion boolean, validado_por string, archivo_origen string, creado_en timestamp"
)
MAPA_F29 = "codigo_f29 string, glosa_f29 string, codigo_balance string, glosa_balance string, factor float, activo boolean"

EXCLUDED = "__EXCLUIR__"
ORIGINS = ("activo", "pasivo", "perdida", "ganancia", "deudor", "acreedor", "desconocido")
FORMATS = ("guion", "punto", "compacto", "sin_codigo")
REVIEW_BELOW = 0.85
