"""Fixed values of the special rules, the column correction and the ambiguous names."""

# Words and patterns of the five rules.
BANK_WORDS = ("banco", "cta cte", "cuenta corriente banco", "disponible", "efectivo")
CLIENT_WORDS = ("cliente", "deudor por venta", "factura por cobrar")
PROPERTY_SECTORS = ("inmobiliaria", "arriendo bienes inmuebles", "construccion", "promotora", "bienes raices", "desarrollo inmobiliario")
LAND = r"\bterreno(s)?\b"
DEFERRED_INCOME = (
    r"ingreso(s)?\s+(percibido|recibido).*(adelantado|anticipado|avance)|anticipo\s+de\s+cliente(s)?|ing\s+percibido(s)?\s+por\s+adelantado"
)
SHAREHOLDER = (
    r"(cuenta\s+(particular|corriente)\s+(socio|accionista))|(cta\.?\s*(cte\.?|particular)\s+(socio|accionista))|"
    r"\bretiro(s)?\s+(de\s+)?(socio|utilidad)\b|\bdividendo(s)?\s+(provisorio(s)?|anticipado(s)?|pagado(s)?)\b|"
    r"\bdistribucion(es)?\s+(a\s+)?(socio|accionista)\b|\bsocios?\s+cuenta\s+corriente\b"
)
# Flag of each rule, in order
FLAGS = ("es_sobregiro", "terreno_para_venta", "era_activo_incorrecto", "anticipo_cliente_negativo", "ajuste_patrimonio_conservador")

# Name: (code on the income side, code on the expense side)
AMBIGUOUS_NAMES = {
    "arriendos": ("ER.01", "ER.04"), "arriendo": ("ER.01", "ER.04"), "intereses": ("ER.12", "ER.09"), "interes": ("ER.12", "ER.09"),
    "honorarios": ("ER.01", "ER.04"), "comisiones": ("ER.01", "ER.05"), "servicios": ("ER.01", "ER.04"),
}
# Keyword in a name: (code on the income side, code on the expense side), in order
AMBIGUOUS_WORDS = [
    ("arriendo", "ER.01", "ER.04"), ("interes", "ER.12", "ER.09"), ("comision", "ER.01", "ER.05"), ("servicio", "ER.01", "ER.04"),
    ("honorario", "ER.01", "ER.04"), ("diferencia de cambio", "ER.15", "ER.15"), ("correccion monetaria", "ER.14", "ER.14"),
    ("otras ganancias", "ER.13", "ER.13"), ("reajuste", "ER.14", "ER.14"),
]
OVERDRAFT_WORDS = ("banco", "cta cte", "cuenta corriente")
INCOME_SIDE, EXPENSE_SIDE = ("ganancia", "activo"), ("perdida", "pasivo")

# Words in an account's name that tell its column, in order
COLUMN_WORDS = {
    "activo": ("caja", "banco", "clientes", "iva", "activo", "fijo", "existencias", "ppm"),
    "pasivo": ("proveedores", "acreedores", "capital", "retenciones", "pasivo", "letras por pagar"),
    "perdida": ("gasto", "costo", "arriendo", "remuneraciones", "perdida", "patente", "honorarios"),
    "ganancia": ("venta", "ingreso", "ganancia", "utilidad", "percibido"),
}
# Labels of the methods, and names of the months.
METHOD_LABELS = {
    "codigo": "0 · Código de cuenta", "diccionario_exacto": "1 · Diccionario (exacto)", "diccionario_fuzzy": "1b · Diccionario (fuzzy)",
    "regla_regex": "2 · Reglas regex", "sin_clasificar": "3-4 · Pendiente (embeddings/LLM)",
}
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
