"""Aggregation and reconciliation of classified accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.rules import catalog as C
from saldospark.rules.special import METHOD_LABELS
from saldospark.schemas import EXCLUDED

BALANCE_TOLERANCE, PROFIT_TOLERANCE = 10.0, 1000.0
#: Order of a statement.
BALANCE_ORDER = ("orden", "codigo_clasificado")


def classified(df: DataFrame) -> DataFrame:
    return df.where((F.col("codigo_clasificado") != "") & (F.col("codigo_clasificado") != EXCLUDED) & ~F.col("es_total"))


def excluded(df: DataFrame) -> DataFrame:
    return df.where(F.col("codigo_clasificado") == EXCLUDED)


def review_queue(df: DataFrame) -> DataFrame:
    return df.where((F.col("requiere_revision") | (F.col("codigo_clasificado") == "")) & ~F.col("es_total"))


def pending_by_document(df: DataFrame) -> DataFrame:
    """(doc_id, pendientes, total): also documents without pending rows."""
    pending = (F.col("requiere_revision") | (F.col("codigo_clasificado") == "")) & ~F.col("es_total")
    return df.groupBy("doc_id").agg(F.count_if(pending).alias("pendientes"), F.count("*").alias("total"))


def category_rank(category: Column) -> Column:
    """Place of a category in the statement; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, C.CATEGORIES.values())), category).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.lit(C.UNKNOWN_RANK))


def _total(c: str = "monto") -> Column:
    return F.sum(T.exact(F.coalesce(F.col(c), F.lit(0.0)))).cast("double")


def balance(df: DataFrame, catalog: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Amount and number of accounts per standard code, with name, category and rank; ``by`` adds keys such as doc_id.

    Sums are decimal, so they don't depend on the order of rows. The catalog has a fixed, small size. Rows come in no order: the
    statement's order is ``BALANCE_ORDER``, and the sink sorts.
    """
    grouped = classified(df).groupBy(*by, "codigo_clasificado").agg(_total().alias("monto_total"), F.count("nombre_original").alias("num_cuentas"))
    names = F.broadcast(catalog.select(F.col("codigo_estandar").alias("codigo_clasificado"), "nombre_estandar", "categoria"))
    out = grouped.join(names, "codigo_clasificado", "left").withColumns(
        {"nombre_estandar": F.coalesce("nombre_estandar", "codigo_clasificado"), "categoria": F.coalesce("categoria", F.lit(""))}
    )
    return out.withColumn("orden", category_rank(F.col("categoria")))


def balance_sections(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """The statement by sections: (orden, titulo, codigo, cuenta, monto_total, num_cuentas, subtotal) of the six categories, empty ones left out.

    Codes of no known category are in no section.
    """
    rows = balance(df, catalog).where(F.col("orden") < C.UNKNOWN_RANK)
    title = F.element_at(F.array(*map(F.lit, C.SECTIONS)), F.col("orden") + 1)
    total = F.sum(T.exact(F.col("monto_total"))).over(Window.partitionBy("orden")).cast("double")  # a row for each standard code
    return rows.select("orden", title.alias("titulo"), F.col("codigo_clasificado").alias("codigo"), F.col("nombre_estandar").alias("cuenta"), "monto_total", "num_cuentas", total.alias("subtotal"))


def balance_rollup(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Totals per code, per category and overall, in one pass; ``nivel`` is 0, 1 or 3."""
    names = F.broadcast(catalog.select(F.col("codigo_estandar").alias("codigo_clasificado"), "categoria"))
    rows = classified(df).join(names, "codigo_clasificado", "left").withColumn("categoria", F.coalesce("categoria", F.lit("")))
    return rows.rollup("categoria", "codigo_clasificado").agg(_total().alias("monto_total"), F.count("nombre_original").alias("num_cuentas"), F.grouping_id().cast("int").alias("nivel"))


def balance_export(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """The statement as exported: whole amounts (half to even), in the order of the statement (a row for each standard code)."""
    return balance(df, catalog).orderBy(*BALANCE_ORDER).select(
        F.col("codigo_clasificado").alias("codigo"), F.col("nombre_estandar").alias("cuenta"), F.bround("monto_total", 0).cast("long").alias("monto"), "num_cuentas"
    )


def account_detail(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accounts with their standard name. Their order is by code and falling absolute amount (``detail_order``); the sink sorts."""
    names = F.broadcast(catalog.select(F.col("codigo_estandar").alias("codigo_clasificado"), "nombre_estandar"))
    out = classified(df).join(names, "codigo_clasificado", "left").withColumn("nombre_estandar", F.coalesce("nombre_estandar", "codigo_clasificado"))
    return out.select("doc_id", "linea", "codigo_clasificado", "nombre_estandar", "nombre_original", "monto", T.percent(F.col("confianza")).alias("confianza_pct"))


def detail_order() -> list[Column]:
    return [F.col("codigo_clasificado"), F.abs("monto").desc_nulls_last(), F.col("doc_id"), F.col("linea")]


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, unclassified, in review, mean positive confidence and the share in review."""
    review = F.count_if("requiere_revision")
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("codigo_clasificado") == "").alias("sin_clasificar"), review.alias("en_revision"),
        F.round(F.avg(F.when(F.col("confianza") > 0, F.col("confianza"))), 6).alias("confianza_promedio"),
        F.round(100 * review / F.count("*"), 6).alias("porcentaje_revision"),
    )


def method_distribution(df: DataFrame) -> DataFrame:
    """(metodo, etiqueta, cuentas) per base method, most frequent first."""
    labels = F.create_map(*[F.lit(x) for kv in METHOD_LABELS.items() for x in kv])
    base = T.base_method(F.col("metodo"))
    return df.groupBy(base.alias("metodo")).agg(F.count("*").alias("cuentas")).select(
        "metodo", F.coalesce(F.try_element_at(labels, F.col("metodo")), F.col("metodo")).alias("etiqueta"), "cuentas"
    ).orderBy(F.desc("cuentas"), "metodo")


def effective_equity(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Book equity (PAT.01 to PAT.04), shareholder adjustment (AC.06S), effective equity and its two flags.

    Only groups with an account of the category patrimonio give a row.
    """
    amount, code = T.exact(F.coalesce(F.col("monto"), F.lit(0.0))), F.col("codigo_clasificado")
    zero = F.lit(0).cast("decimal(20,2)")
    sums = classified(df).groupBy(*by).agg(
        F.sum(F.when(code.isin("PAT.01", "PAT.02", "PAT.03", "PAT.04"), amount).otherwise(zero)).cast("double").alias("pat"),
        F.sum(F.when(code == "AC.06S", amount).otherwise(zero)).cast("double").alias("m"),
        F.count_if(code.startswith("PAT")).alias("n"),
    ).where("n > 0")
    return sums.select(
        *by, F.round("pat", 2).alias("patrimonio_contable"), F.round(F.abs("m"), 2).alias("ajuste_cta_socios"),
        F.round(F.col("pat") - F.abs("m"), 2).alias("patrimonio_efectivo"), (F.col("m") > 0).alias("tiene_ajuste"), (F.col("m") > F.col("pat") * 0.20).alias("alerta"),
    )


def totals_by_origin(df: DataFrame, by: str = "doc_id") -> DataFrame:
    """Sums of the four columns per document, without total rows."""
    amount = T.exact(F.when(~F.col("es_total"), F.col("monto")))
    zero = F.lit(0).cast("decimal(20,2)")
    return df.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col("origen_columna") == o, amount)), zero).cast("double").alias(o) for o in ("activo", "pasivo", "perdida", "ganancia")])


def balance_check(df: DataFrame, by: str = "doc_id") -> DataFrame:
    """Whether assets less liabilities equal income less expenses, with the difference and an alert text."""
    sums = totals_by_origin(df, by)
    left, right = F.col("activo") - F.col("pasivo"), F.col("ganancia") - F.col("perdida")
    gap = F.abs(left - right)
    text = F.concat(F.lit("CONTROL DE CUADRE FALLIDO: Activos ("), T.money(F.col("activo")), F.lit(") - Pasivos ("), T.money(F.col("pasivo")), F.lit(") | Ganancias ("),
                    T.money(F.col("ganancia")), F.lit(") - Pérdidas ("), T.money(F.col("perdida")), F.lit("). Diferencia: "), T.money(gap))
    return sums.select("*", F.round(gap, 2).alias("diferencia"), (gap < BALANCE_TOLERANCE).alias("cuadra"), F.when(gap >= BALANCE_TOLERANCE, text).alias("alerta"))


def profit_check(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ER.11 against PAT.04: both totals (null if absent), the difference and a state."""
    amount, code = T.exact(F.coalesce(F.col("monto"), F.lit(0.0))), F.col("codigo_clasificado")
    sums = classified(df).groupBy(*by).agg(*[F.sum(F.when(code == c, amount)).cast("double").alias(n) for c, n in (("ER.11", "er11"), ("PAT.04", "pat04"))])
    gap = F.round(F.abs(F.col("er11") - F.col("pat04")), 2)
    state = (
        F.when(F.col("er11").isNull() & F.col("pat04").isNull(), F.lit("sin_datos")).when(F.col("er11").isNull(), F.lit("sin_er11"))
        .when(F.col("pat04").isNull(), F.lit("sin_pat04")).when(gap <= PROFIT_TOLERANCE, F.lit("cuadra")).otherwise(F.lit("descuadre"))
    )
    return sums.select(*by, "er11", "pat04", gap.alias("diferencia"), state.alias("estado"))


def result_detail(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Codes of the income statement by falling absolute total."""
    return balance(df, catalog).where(F.col("codigo_clasificado").startswith("ER")).select("codigo_clasificado", "nombre_estandar", "monto_total").orderBy(F.abs("monto_total").desc(), "codigo_clasificado")


def sign_candidates(df: DataFrame, check: DataFrame) -> DataFrame:
    """Accounts whose absolute amount lies within 5 % (1,000 at least) of a document's profit difference.

    ``check`` has one row per document (``profit_check`` by doc_id); the band is a condition on the document's join.
    """
    gaps = check.where(F.col("estado") == "descuadre").select("doc_id", "diferencia")
    near = F.abs(F.abs("monto") - F.col("diferencia")) <= F.greatest(F.col("diferencia") * 0.05, F.lit(PROFIT_TOLERANCE))
    return classified(df).join(gaps, "doc_id").where(near).select("doc_id", "linea", "nombre_original", "monto", "codigo_clasificado")


def sales_deviation(df: DataFrame, declared: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Extension: declared annual sales (doc_id, ventas_anuales) against ER.01; alert above ``threshold`` percent."""
    sales = classified(df).where("codigo_clasificado = 'ER.01'").groupBy("doc_id").agg(_total().alias("ventas_balance"))
    gap = F.when(F.col("ventas_anuales") != 0, F.abs(F.col("ventas_balance") - F.col("ventas_anuales")) / F.abs("ventas_anuales") * 100)
    return declared.join(sales, "doc_id", "left").select("doc_id", "ventas_anuales", "ventas_balance", F.round(gap, 4).alias("desviacion_pct"), F.coalesce(gap > threshold, F.lit(False)).alias("alerta"))
