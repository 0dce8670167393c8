"""From files of any kind to accounts, profiles and notes: one entry that dispatches by suffix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldospark.functions.plan import cut
from saldospark.operators.balance import balance_check
from saldospark.operators.metadata import extract_metadata
from saldospark.operators.parse import parse_cells, parse_lines
from saldospark.operators.profile import profile, warnings
from saldospark.sources import files

SPREADSHEETS = ("xlsx", "xlsm", "xls")


@dataclass
class Documents:
    """``cuentas``: accounts of all documents; ``perfiles``: a row for each file with its profile and notes; ``metadatos``: header data."""

    cuentas: DataFrame
    perfiles: DataFrame
    metadatos: DataFrame


def read_documents(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None, expected: DataFrame | None = None) -> Documents:
    """Read every file under ``path``: text files and, with ``pages``, PDF files as lines, workbooks as cells.

    Files that fail their check give no account; their note says why. A file without text is noted too, and so are a sheet or
    page that can't be read and a failed balance check. Other suffixes count as text only if they are ``txt``. Binary workbooks (``xls``) pass
    their check, but no reader for them is here, so they are files without text.

    Every file is read once: its check, lines, header, cells and notes come from one pass, which is cut.
    """
    return from_parts(cut(files.document_parts(files.binary_files(spark, path), pages)), expected)


def from_parts(parts: DataFrame, expected: DataFrame | None = None) -> Documents:
    """Documents from their parts (``files.PARTS``), whichever reader made them. ``parts`` is read several times."""
    checked, lines, cells, head = files.checked(parts, expected), files.lines_of(parts), files.cells_of(parts), files.lines_of(parts, "cabecera")
    profiles = profile(lines)
    from_lines = parse_lines(lines, profiles)
    accounts = from_lines.unionByName(parse_cells(cells))
    read = lines.select("doc_id").unionByName(cells.select("doc_id")).distinct()
    failed = checked.where("not valido").select("doc_id", F.concat(F.lit("VALIDACIÓN FALLIDA: "), "mensaje").alias("falla"))
    notes = warnings(profiles, balance_check(from_lines)).select("doc_id", F.col("advertencias").alias("_w"))
    book = F.lower("doc_id").rlike(r"\.xls[xm]$")
    silent = checked.where(F.col("valido") & ~book).select("doc_id").join(read, "doc_id", "left_anti").select("doc_id", F.lit("No se pudo extraer texto (ni nativo ni OCR)").alias("vacio"))
    joined = checked.select("doc_id", "valido").join(profiles, "doc_id", "left").join(notes, "doc_id", "left").join(failed, "doc_id", "left").join(silent, "doc_id", "left").join(files.notes_of(parts), "doc_id", "left")
    all_notes = F.concat(F.array_compact(F.array("falla", "vacio")), F.coalesce("notas", F.array().cast("array<string>")), F.coalesce("_w", F.array().cast("array<string>")))
    return Documents(
        accounts,
        joined.select(
            "doc_id", "valido", F.coalesce("formato_codigo", F.lit("sin_codigo")).alias("formato_codigo"), F.coalesce("separador_miles", F.lit(".")).alias("separador_miles"),
            F.coalesce("requirio_ocr", F.lit(False)).alias("requirio_ocr"), F.coalesce("rotacion_aplicada", F.lit(0)).alias("rotacion_aplicada"), all_notes.alias("advertencias"),
        ),
        extract_metadata(head),
    )
