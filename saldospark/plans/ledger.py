"""A deterministic ledger over ``lineitem``, written once in Spark and once in SQL for DuckDB.

The test tables aren't accounting data. A supplier stands for a document; account codes, names, amounts and
columns follow from the row's keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldospark.sources.tables import dictionary

NAMES = [
    "Caja", "Banco Estado", "Clientes Nacionales", "Documentos por Cobrar", "Mercaderias", "IVA Credito Fiscal", "Terreno Los Andes", "Maquinarias",
    "Proveedores", "Leasing LP", "Factoring", "Impuesto a la Renta", "Remuneraciones por Pagar", "Anticipo de Clientes", "Ingresos Percibidos por Adelantado",
    "Cuenta Corriente Socio", "Retiros de Socio", "Dividendos Provisorios", "Capital Pagado", "Reserva Legal", "Utilidad Acumulada", "Utilidad del Ejercicio",
    "Ventas", "Costo de Ventas", "Gastos de Administracion", "Gastos de Ventas", "Depreciacion", "Gastos Financieros", "Utilidad Neta", "Arriendos", "Intereses",
    "Honorarios", "Comisiones", "Servicios", "Arriendo Bodega", "Diferencia de Cambio", "Reajuste U.F.", "Balance General", "Cuenta Puente X", "Prestamo Bancario",
    "Banco BCI Cta Cte", "Bonos",
]
ORIGINS = ["activo", "pasivo", "perdida", "ganancia", "desconocido"]
DICTIONARY = [
    ("Caja General", "AC.01", "manual"), ("Banco Estado", "AC.02", "manual"), ("Proveedor", "PC.01", "manual"), ("Cliente Nacionales", "AC.03", "manual"),
    ("Prestamos Bancarios", "PC.02", "manual"), ("cuenta puente x.", "PC.08", "manual"), ("BANCO ESTADO", "AC.01", "validacion"), ("Administracion Gastos de", "ER.04", "manual"),
    ("Honorarios Directorio", "ER.04", "manual"), ("Ventas Netas", "ER.01", "manual"), ("Gasto Financiero", "ER.09", "manual"), ("Codigo Suelto", "XX.99", "manual"),
]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, linea, codigo, nombre, monto, origen_columna, es_total, confianza_extraccion, giro."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    if t.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # fewer splits than cores: a small table of large row groups
        t = t.repartition(spark.sparkContext.defaultParallelism)
    k = F.col
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    a, b, c = 1 + k("l_suppkey") % 9, 1 + k("l_partkey") % 3, k("l_linenumber") + k("l_orderkey") % 5
    code = (
        F.when(k("l_partkey") % 4 == 0, F.format_string("%d-%02d-%02d-01", a, b, c)).when(k("l_partkey") % 4 == 1, F.format_string("%d.%02d.%02d.01", a, b, c))
        .when(k("l_partkey") % 4 == 2, ((1 + k("l_suppkey") % 8) * 1000000 + (k("l_orderkey") % 22) * 10000 + k("l_partkey") % 1000).cast("string"))
    )
    amount = F.when((k("l_linenumber") == 6) & (k("l_partkey") % 10 == 0), F.lit(None).cast("double")).when(k("l_returnflag") == "R", -k("l_extendedprice")).otherwise(k("l_extendedprice"))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    return t.select(
        k("l_suppkey").alias("doc_id"), (F.row_number().over(order) - 1).alias("linea"), code.alias("codigo"), pick(NAMES, k("l_partkey") + k("l_linenumber")).alias("nombre"),
        amount.alias("monto"), pick(ORIGINS, k("l_orderkey")).alias("origen_columna"), (k("l_linenumber") == 7).alias("es_total"), F.lit(1.0).alias("confianza_extraccion"),
        F.when(k("l_suppkey") % 3 == 0, F.lit("Inmobiliaria Sur")).when(k("l_suppkey") % 3 == 1, F.lit("Comercio")).alias("giro"),
    )


def seed_dictionary(spark: SparkSession) -> DataFrame:
    return dictionary(spark, DICTIONARY)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


LEDGER_SQL = f"""ledger as (
    select l_suppkey as doc_id,
        cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as integer) as linea,
        case l_partkey % 4
            when 0 then printf('%d-%02d-%02d-01', 1 + l_suppkey % 9, 1 + l_partkey % 3, l_linenumber + l_orderkey % 5)
            when 1 then printf('%d.%02d.%02d.01', 1 + l_suppkey % 9, 1 + l_partkey % 3, l_linenumber + l_orderkey % 5)
            when 2 then cast((1 + l_suppkey % 8) * 1000000 + (l_orderkey % 22) * 10000 + l_partkey % 1000 as varchar) end as codigo,
        ({_list(NAMES)})[1 + (l_partkey + l_linenumber) % {len(NAMES)}] as nombre,
        case when l_linenumber = 6 and l_partkey % 10 = 0 then null when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as monto,
        ({_list(ORIGINS)})[1 + l_orderkey % {len(ORIGINS)}] as origen_columna, l_linenumber = 7 as es_total, 1.0::double as confianza_extraccion,
        case l_suppkey % 3 when 0 then 'Inmobiliaria Sur' when 1 then 'Comercio' end as giro
    from lineitem)"""
