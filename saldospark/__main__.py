"""Command lines: ``python -m saldospark parse PATH`` and ``python -m saldospark load CATALOG DICTIONARY [DATABASE]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldospark.plans import statement
from saldospark.sources import tables

SHOWN = 25


def account_line(row) -> str:
    total = " [TOTAL]" if row["es_total"] else ""
    return f"  [{row['codigo'] or '-':18s}] {row['nombre'][:45]:45s} monto={row['monto']!s:>15} ({row['origen_columna']}){total}"


def describe(profiles: DataFrame, accounts: DataFrame, shown: int = SHOWN) -> list[str]:
    """What ``parse`` prints: the profile of each of up to ``shown`` documents, how many accounts there are, and the first ``shown`` of them."""
    out = []
    for p in profiles.orderBy("doc_id").limit(shown).collect():
        out += [
            f"Archivo: {p['doc_id']}", f"Formato código: {p['formato_codigo']}", f"Separador miles: '{p['separador_miles']}'",
            f"Requirió OCR: {p['requirio_ocr']} (rotación {p['rotacion_aplicada']}°)", f"Advertencias: {list(p['advertencias'])}",
        ]
    return [*out, f"Total cuentas extraídas: {accounts.count()}", "", *map(account_line, accounts.orderBy("doc_id", "linea").limit(shown).collect())]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="saldospark")
    commands = parser.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="accounts of the documents under a path")
    parse.add_argument("path")
    parse.add_argument("--out", help="write the accounts there, as Parquet")
    load = commands.add_parser("load", help="catalog and dictionary into the tables of a database")
    load.add_argument("catalog")
    load.add_argument("dictionary")
    load.add_argument("database", nargs="?", default="default")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("saldospark").getOrCreate()
    if given.command == "parse":
        found = statement.read_documents(spark, given.path)
        print("\n".join(describe(found.perfiles, found.cuentas)))
        if given.out:
            found.cuentas.withColumn("leido_en", F.current_timestamp()).write.mode("overwrite").parquet(given.out)
    else:
        codes, names = tables.load(spark, given.catalog, given.dictionary, given.database)
        print(f"Carga inicial ejecutada con éxito: {codes} códigos, {names} nombres")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
