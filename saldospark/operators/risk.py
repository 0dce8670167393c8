"""Outputs for a risk committee: sales deviation, large withdrawals, notes by activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.operators.balance import classified, sales_deviation

WITHDRAWAL = "AC.06S"
#: Size parameter of the quantile sketches: a rank is off by some 1.33 % at most (two-sided, 99 %).
SKETCH = 200
RANK_ERROR = 0.0133

# Notes for three activities, in order
NOTES = {
    "inmobiliaria": (
        "Participación significativa en una sola obra",
        "Alta rotación de propiedades sin plusvalía real",
        "Dependencia excesiva de financiamiento bancario de corto plazo",
    ),
    "construccion": (
        "Descalce significativo entre avance de obra y facturación",
        "Concentración en pocos clientes o contratos públicos",
        "Evolución desfavorable de costos de materiales clave",
    ),
    "comercio": (
        "Caída drástica en la rotación de inventarios",
        "Aumento desproporcionado de cuentas por cobrar vs ventas",
        "Margen bruto decreciente en los últimos trimestres",
    ),
}


def withdrawals(df: DataFrame, by: str = "giro") -> DataFrame:
    """(doc_id, linea, giro, retiro): shareholders' withdrawals, by absolute amount; an unknown activity is ''."""
    return classified(df).where((F.col("codigo_clasificado") == WITHDRAWAL) & F.col("monto").isNotNull()).select(
        "doc_id", "linea", F.coalesce(by, F.lit("")).alias("giro"), F.abs("monto").alias("retiro")
    )


def sketches(rows: DataFrame) -> DataFrame:
    """(giro, n, retiros): a quantile sketch for each activity. Sketches are partial aggregates: a frequent activity is combined before the shuffle."""
    return rows.groupBy("giro").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("retiro", F.lit(SKETCH)).alias("retiros"))


def merged(parts: DataFrame) -> DataFrame:
    """One sketch for each activity from sketches of parts (months, tables): what was seen needn't be read again."""
    return parts.groupBy("giro").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("retiros", F.lit(SKETCH)).alias("retiros"))


def quantiles(sketched: DataFrame) -> DataFrame:
    """(giro, n, q1, mediana, q3, limite): quartiles within ``RANK_ERROR`` of their rank, and the robust bound q3 + 3 (q3 - q1)."""
    q = sketched.select("giro", "n", *[F.kll_sketch_get_quantile_double("retiros", F.lit(p)).alias(c) for p, c in ((0.25, "q1"), (0.5, "mediana"), (0.75, "q3"))])
    return q.withColumn("limite", F.col("q3") + 3 * (F.col("q3") - F.col("q1")))


def large_withdrawals(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, linea, giro, retiro, limite) of withdrawals above the limit of their activity; limits(giro, limite) has a row for each activity."""
    return rows.join(limits.select("giro", "limite"), "giro").where("retiro > limite").select("doc_id", "linea", "giro", "retiro", "limite")


def notes(documents: DataFrame, activity: str = "giro") -> DataFrame:
    """(doc_id, orden, nota): the notes of the first activity that the document's contains, accents folded."""
    name = F.translate(F.lower(F.col(activity)), "áéíóú", "aeiou")
    found = F.coalesce(*[F.when(name.contains(a), F.array(*map(F.lit, texts))) for a, texts in NOTES.items()])
    return documents.select("doc_id", F.posexplode(found).alias("orden", "nota"))


def alerts(df: DataFrame, declared: DataFrame, limits: DataFrame, activity: str = "giro") -> DataFrame:
    """(doc_id, tipo, orden, alerta): what the committee is told of each document.

    Sales that deviate from the declared ones, withdrawals above the activity's limit (largest first), and the activity's notes.
    """
    sales = sales_deviation(df, declared).where("alerta").select(
        "doc_id", F.lit("ventas").alias("tipo"), F.lit(0).alias("orden"),
        F.concat(F.lit("Ventas del balance ("), T.money(F.col("ventas_balance")), F.lit(") se desvían de las declaradas ("), T.money(F.col("ventas_anuales")), F.lit(")")).alias("alerta"),
    )
    text = F.concat(F.lit("Retiro de socios ("), T.money(F.col("retiro")), F.lit(") sobre el límite del giro ("), T.money(F.col("limite")), F.lit(")"))
    large = large_withdrawals(withdrawals(df, activity), limits).select("doc_id", F.lit("retiro").alias("tipo"), F.col("linea").cast("int").alias("orden"), text.alias("alerta"))
    documents = df.groupBy("doc_id").agg(F.min(activity).alias(activity))
    noted = notes(documents, activity).select("doc_id", F.lit("giro").alias("tipo"), "orden", F.col("nota").alias("alerta"))
    return sales.unionByName(large).unionByName(noted)
