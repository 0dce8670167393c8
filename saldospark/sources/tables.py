"""Catalog, dictionary and audit tables: JSON, JDBC and Parquet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldospark import schemas
from saldospark.functions import text as T
from saldospark.sources import merge
from saldospark.sources.jsonarray import read_json_array
from saldospark.sources.ordered import write_ordered

#: What an error says when a source isn't there: no path, no table, no driver. A database that refuses or times out is an error.
ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "No suitable driver", "ClassNotFoundException")
#: Keys up to which a list is handed to the scan as a filter.
LOOKUP_KEYS = 1_000

_RECORD = (
    "struct<codigo_estandar: string, nombre_estandar: string, categoria: string, tipo_estado: string, naturaleza: string, signo_normal: smallint, "
    "es_deuda_financiera: boolean, es_activo_liquido: boolean, afecta_ebitda: boolean, descripcion: string>"
)


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """The catalog from a JSON object keyed by code."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", f"map<string, {_RECORD}>")).alias("k", "r"))
    return entries.select("r.*", F.lit(True).alias("activo"))


def read_dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """(cuenta_original, codigo_estandar, fuente, seq) from a JSON array; ``seq`` is the place in the array."""
    entries = read_json_array(spark, path, "cuenta_original string, codigo_estandar string, fuente string")
    return entries.select("r.cuenta_original", "r.codigo_estandar", "r.fuente", F.col("lugar").alias("seq"))


def dictionary(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A dictionary from (name, code, source) entries, in their order."""
    return spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], "cuenta_original string, codigo_estandar string, fuente string, seq long")


def as_stored(entries: DataFrame) -> DataFrame:
    """Dictionary entries in the stored schema, one per normalised name (the last one)."""
    keyed = entries.withColumn("cuenta_normalizada", T.normalize_name(F.col("cuenta_original")))
    latest = keyed.groupBy("cuenta_normalizada").agg(F.max_by(F.struct("cuenta_original", "codigo_estandar", "fuente", "seq"), "seq").alias("r"))
    return latest.select(
        "r.cuenta_original", "cuenta_normalizada", "r.codigo_estandar", "r.fuente", F.lit(False).alias("validado_humano"), F.lit(None).cast("string").alias("validado_por"),
        F.lit(None).cast("timestamp").alias("validado_en"), F.lit(1).alias("frecuencia_uso"), F.lit(True).alias("activo"),
        F.current_timestamp().alias("creado_en"), F.current_timestamp().alias("actualizado_en"), "r.seq",
    )


def read_or_empty(read: Callable[[], DataFrame], fallback: Callable[[], DataFrame] | None = None, schema: str = schemas.CATALOGO, spark: SparkSession | None = None) -> DataFrame:
    """What ``read`` gives; where its driver, table or path isn't there, what ``fallback`` gives, else an empty table.

    Anything else raises: a database that is named but doesn't answer isn't an empty catalog.
    """
    for attempt in filter(None, (read, fallback)):
        try:
            return attempt()
        except Exception as e:  # analysis errors and a driver's own
            if not any(x in str(e) for x in ABSENT):
                raise
    return (spark or SparkSession.active()).createDataFrame([], schema)


def load(spark: SparkSession, catalog_path: str, dictionary_path: str, database: str = "default") -> tuple[int, int]:
    """Catalog and dictionary from JSON files into the persistent tables, entry by entry: a known code or name is replaced.

    Returns the numbers of rows that the tables then hold. Loading the same files again changes nothing but times, and only the
    buckets that entries fall into are rewritten (see ``merge``).
    """
    create_tables(spark, database)
    catalog = read_catalog_json(spark, catalog_path)
    entries = as_stored(read_dictionary_json(spark, dictionary_path))
    counts = []
    for name, rows, key in (("catalogo_maestro", catalog, "codigo_estandar"), ("diccionario_homologacion", entries, "cuenta_normalizada")):
        table = f"{database}.{name}"
        merge.merge(rows.select(*[c for c in spark.table(table).columns if c != merge.BUCKET]), table, key)
        counts.append(spark.table(table).count())
    return counts[0], counts[1]


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The persistent tables, as Parquet, where they don't exist; the two that are merged into are divided by a bucket of their key."""
    for name, columns in (("catalogo_maestro", schemas.CATALOGO), ("diccionario_homologacion", schemas.DICCIONARIO)):
        merge.create(spark, f"{database}.{name}", columns)
    for name, columns in (("log_validaciones", schemas.LOG_VALIDACIONES), ("mapa_f29", schemas.MAPA_F29)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def append_audit(log: DataFrame, table: str = "log_validaciones") -> None:
    log.withColumn("creado_en", F.current_timestamp()).write.mode("append").insertInto(table)


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, column: str | None = None, partitions: int = 8,
    hashed: bool = False, fetch: int = 10_000, connect_seconds: int = 3, query_seconds: int = 0,
) -> DataFrame:
    """A table over JDBC; filters and columns on it are pushed down by Spark. The driver's jar and the password are the caller's.

    ``column`` (a whole number) divides the scan into ``partitions`` connections: ranges between the bounds that one
    query finds, or with ``hashed`` remainders, which stay even where the numbers are not. Null keys are part of the first partition. ``fetch`` rows come at a
    time; ``connect_seconds`` and ``query_seconds`` are time-outs (0: none), the first handed to the driver as ``loginTimeout``.
    """
    options = {"loginTimeout": str(connect_seconds), "fetchsize": str(fetch), "queryTimeout": str(query_seconds), **(properties or {})}
    if column is None or partitions <= 1:
        return spark.read.jdbc(url, table, properties=options)
    if hashed:
        rest = f"MOD({column}, {partitions})"
        parts = [f"{rest} = {i} OR {rest} = {i - partitions}" if i else f"{rest} = 0 OR {column} IS NULL" for i in range(partitions)]
        return spark.read.jdbc(url, table, predicates=parts, properties=options)
    bounds = spark.read.jdbc(url, f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) bounds", properties=options).first()
    lo, hi = bounds[0], bounds[1]
    if lo is None:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column=column, lowerBound=int(lo), upperBound=int(hi) + 1, numPartitions=max(1, min(partitions, int(hi) - int(lo) + 1)), properties=options)


def write_dictionary_json(entries: DataFrame, path: str) -> None:
    entries.select("cuenta_original", "codigo_estandar", "fuente").coalesce(1).write.mode("overwrite").json(path)


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one key (first by all columns, if there are several)."""
    return df.where(F.col(key) == value).orderBy(*df.columns).limit(1)


def write_lookup(df: DataFrame, path: str, key: str, files: int = 8, row_group_bytes: int = 16 << 20, distinct: int = 1_000_000) -> None:
    """``df`` as Parquet in the order of ``key``, range by range, with a Bloom filter of the key in each row group.

    Ranges and statistics let a scan skip files and row groups by bounds, the filters those that hold a range but not the key.
    """
    ordered = df.repartitionByRange(files, key).sortWithinPartitions(key)
    (ordered.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
     .option("parquet.block.size", str(row_group_bytes)).parquet(path))


def lookup_many(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose ``key`` is among those of ``wanted``.

    Up to ``LOOKUP_KEYS`` keys are handed to the scan as a list, which prunes files and row groups before anything is read; more
    are a semi join (with Spark's runtime filter where it pays). Null keys find nothing.
    """
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    few = keys.limit(LOOKUP_KEYS + 1).collect()
    if len(few) <= LOOKUP_KEYS:
        return table.where(F.col(key).isin([r[0] for r in few])) if few else table.where(F.lit(False))
    return table.join(keys, key, "left_semi")


def write_statement(balance: DataFrame, path: str, detail: DataFrame | None = None, meta: DataFrame | None = None, detail_order: Sequence[str | Column] = (), files: int = 8) -> None:
    """An exported statement as CSV with a header: ``balance``, and on wish the accounts (``detalle``) and header cells (``encabezado``) beside it.

    The accounts are in the order of ``detail_order``, over numbered files; the other two have few rows and keep theirs.
    """
    if detail is not None and detail_order:
        write_ordered(detail, f"{path}/detalle", detail_order, files, "csv", header="true")
        detail = None
    parts = {"balance": balance, "detalle": detail, "encabezado": meta if meta is None else export_header(meta)}
    for name, df in parts.items():
        if df is not None:
            df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def export_header(meta: DataFrame) -> DataFrame:
    """(doc_id, fila, etiqueta, valor): the cells above an exported statement."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    period = F.concat(text("periodo_desde"), F.lit(" al "), text("periodo_hasta"))
    cells = [("Empresa:", text("razon_social")), ("RUT:", text("rut")), ("Período:", period), ("Giro:", text("giro"))]
    rows = F.array(*[F.struct(F.lit(i).alias("fila"), F.lit(label).alias("etiqueta"), v.alias("valor")) for i, (label, v) in enumerate(cells, 1)])
    return meta.select("doc_id", F.inline(rows))


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def export_name(meta: DataFrame) -> DataFrame:
    """(doc_id, archivo): file name from company name (30 characters) and the digits of the tax id."""
    company = F.regexp_replace(F.coalesce("razon_social", F.lit("Empresa")), r"(?U)[^\p{L}\p{N}]+", "_")
    return meta.select("doc_id", F.concat(F.lit("Balance_Unificado-"), F.substring(company, 1, 30), F.lit("-"), F.regexp_replace(F.coalesce("rut", F.lit("")), r"[^0-9kK]", "")).alias("archivo"))
