"""The master catalog. Names are fixed values; the other fields follow from the code by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saldospark.schemas import CATALOGO

# Standard codes and names.
NAMES = [
    ("AC.01", "Caja y Bancos"),
    ("AC.02", "Inversiones Corto Plazo"),
    ("AC.03", "Clientes"),
    ("AC.04", "Documentos por Cobrar"),
    ("AC.05", "Inventarios"),
    ("AC.06", "Relacionadas CP"),
    ("AC.06S", "Cta. Cte. Socios / Retiros (Activo)"),
    ("AC.07", "Otras Cuentas por Cobrar CP"),
    ("AC.08", "Otros Activos Corrientes"),
    ("ANC.01", "Activo Fijo"),
    ("ANC.02", "Propiedades de Inversión"),
    ("ANC.03", "Intangibles"),
    ("ANC.04", "Inversiones Permanentes"),
    ("ANC.05", "Relacionadas LP"),
    ("ANC.06", "Otros Activos No Corrientes"),
    ("PC.01", "Proveedores"),
    ("PC.02", "Obligaciones Bancarias CP"),
    ("PC.03", "Leasing CP"),
    ("PC.04", "Factoring"),
    ("PC.05", "Impuestos por Pagar"),
    ("PC.06", "Remuneraciones por Pagar"),
    ("PC.07", "Relacionadas CP"),
    ("PC.08", "Otros Pasivos Corrientes"),
    ("PNC.01", "Obligaciones Bancarias LP"),
    ("PNC.02", "Leasing LP"),
    ("PNC.03", "Bonos"),
    ("PNC.04", "Relacionadas LP"),
    ("PNC.05", "Otros Pasivos LP"),
    ("PAT.01", "Capital"),
    ("PAT.02", "Reservas"),
    ("PAT.03", "Utilidades Retenidas"),
    ("PAT.04", "Resultado del Ejercicio"),
    ("ER.01", "Ventas"),
    ("ER.02", "Costo de Ventas"),
    ("ER.03", "Margen Bruto"),
    ("ER.04", "Gastos de Administración"),
    ("ER.05", "Gastos de Venta"),
    ("ER.06", "EBITDA"),
    ("ER.07", "Depreciación y Amortización"),
    ("ER.08", "Resultado Operacional"),
    ("ER.09", "Gastos Financieros"),
    ("ER.10", "Impuesto a la Renta"),
    ("ER.11", "Utilidad Neta"),
    ("AC.09", "Activos Biológicos CP"),
    ("ANC.07", "Activos Biológicos LP"),
    ("ANC.08", "Plusvalía (Goodwill)"),
    ("PAT.05", "Participaciones No Controladoras"),
    ("ER.12", "Ingresos Financieros"),
    ("ER.13", "Otras Ganancias y Pérdidas"),
    ("ER.14", "Corrección Monetaria y Reajustes"),
    ("ER.15", "Diferencias de Cambio"),
    ("ER.16", "Resultado Método Participación"),
]
# Categories in the order of the statement, and the codes with a flag.
CATEGORIES = {
    "AC": "activo_corriente", "ANC": "activo_no_corriente", "PC": "pasivo_corriente",
    "PNC": "pasivo_no_corriente", "PAT": "patrimonio", "ER": "resultado",
}
# Titles of the sections, in that order.
SECTIONS = ("🟦 Activo Corriente", "🟦 Activo No Corriente", "🟥 Pasivo Corriente", "🟥 Pasivo No Corriente", "🟩 Patrimonio", "🟨 Estado de Resultados")
FINANCIAL_DEBT = ("PC.02", "PC.03", "PC.04", "PNC.01", "PNC.02", "PNC.03")
LIQUID = ("AC.01", "AC.02")
IN_EBITDA = ("ER.01", "ER.02", "ER.04", "ER.05")
EXPENSES = ("ER.02", "ER.04", "ER.05", "ER.07", "ER.09", "ER.10")
UNKNOWN_RANK = 99


def rows() -> list[tuple]:
    """Catalog rows in the order of ``CATALOGO``; descriptions are left to catalogs that are read."""
    out = []
    for code, name in NAMES:
        kind = code.split(".")[0]
        debit = code in EXPENSES if kind == "ER" else kind in ("AC", "ANC")
        sign = (-1 if debit else 1) if kind == "ER" else (1 if debit else -1)
        out.append((code, name, CATEGORIES[kind], "resultados" if kind == "ER" else "balance", "deudora" if debit else "acreedora",
                    sign, code in FINANCIAL_DEBT, code in LIQUID, code in IN_EBITDA, None, True))
    return out


def catalog(spark: SparkSession) -> DataFrame:
    """The master catalog, 52 rows."""
    return spark.createDataFrame(rows(), CATALOGO)
