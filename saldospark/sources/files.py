"""Reading documents: integrity checks, text lines, spreadsheets, and a place for PDF text backends."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, length, suffix) of the files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))


def check(content: bytes, suffix: str) -> str | None:
    """What is wrong with a file's size or signature, by suffix; None if nothing is. Other suffixes pass."""
    if not content:
        return "Archivo vacío (0 bytes)"
    if suffix in ("xlsx", "xlsm"):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return None if "xl/workbook.xml" in z.namelist() else "El .xlsx no contiene workbook.xml válido"
        except zipfile.BadZipFile:
            return "Archivo .xlsx corrupto: no es un ZIP válido" if any(content[:4096]) else "Archivo corrupto: todo ceros binarios"
    if suffix == "xls" and content[:8].hex() != "d0cf11e0a1b11ae1":
        return "Archivo .xls no tiene firma OLE2 válida"
    if suffix == "pdf" and content[:5] != b"%PDF-":
        return "Archivo .pdf no tiene firma PDF válida"
    return None


def check_files(files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(doc_id, valido, mensaje): size and signature by suffix; see ``checked``."""
    return checked(document_parts(files, want=("control",)), expected)


def checked(parts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(doc_id, valido, mensaje) from the parts of documents.

    The reader passes over files of no bytes; ``expected`` (doc_id) names paths that must be there, and those that
    weren't read are reported.
    """
    seen = parts.where("parte = 'control'")
    out = seen.select("doc_id", F.col("texto").isNull().alias("valido"), F.coalesce("texto", F.lit("OK")).alias("mensaje"))
    if expected is not None:
        absent = expected.select("doc_id").join(seen.select("doc_id"), "doc_id", "left_anti")
        out = out.unionByName(absent.select("doc_id", F.lit(False).alias("valido"), F.lit("Archivo no existe o está vacío (0 bytes)").alias("mensaje")))
    return out


def _as_lines(whole: DataFrame) -> DataFrame:
    return whole.select("doc_id", F.posexplode(F.split("value", r"\r?\n")).alias("linea", "texto"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, linea, texto) of text files, a document per file."""
    return _as_lines(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


# The built-in number formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def first_sheet(z: zipfile.ZipFile) -> str | None:
    """The part that holds the first sheet in the workbook's order; the sheet of the lowest number where the workbook doesn't say."""
    book, links = _xml(z, "xl/workbook.xml"), _xml(z, "xl/_rels/workbook.xml.rels")
    named = next((s for s in book.iter() if s.tag.endswith("}sheet")), None) if book is not None else None
    if named is not None and links is not None:
        key = next((v for k, v in named.attrib.items() if k.endswith("}id")), None)
        target = next((r.get("Target") for r in links if r.get("Id") == key), None)
        if target:
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if name in z.namelist():
                return name
    return min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]), default=None)


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date or time."""
    styles = _xml(z, "xl/styles.xml")
    if styles is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(_NS + "numFmt")}
    bare = {k: re.sub(r"\[[^\]]*\]|\"[^\"]*\"|\\\\.", "", v) for k, v in own.items()}
    dated = DATE_FORMATS | {k for k, v in bare.items() if re.search(r"[dmyhs]", v, re.I)}
    formats = styles.find(_NS + "cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in dated}


def _cell(c: ET.Element, shared: list[str], dates: set[int]) -> tuple | None:
    """(kind, text, number) of a cell by its type: "s" text, "n" number or boolean, "d" date; errors and empty cells are None."""
    kind, v = c.get("t"), c.find(_NS + "v")
    if kind == "inlineStr":
        return "s", "".join(t.text or "" for t in c.iter(_NS + "t")), None
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "str":
        return "s", v.text, None
    if kind == "d":
        return "d", v.text, None
    try:
        if kind == "s":
            return "s", shared[int(v.text)], None
        number = float(v.text)
    except (ValueError, IndexError):
        return None
    return ("d", v.text, None) if kind is None and int(c.get("s", 0)) in dates else ("n", None, number)


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """The elements ``tag`` of a part, one at a time: a large sheet is never a tree in memory."""
    with z.open(name) as f:
        steps = ET.iterparse(f, events=("start", "end"))
        _, root = next(steps)
        held = [root]
        for event, e in steps:
            if event == "start":
                held.append(e)
                continue
            held.pop()
            if e.tag == _NS + tag:
                yield e
                held[-1].clear()


def sheet_rows(content: bytes) -> Iterator[list[tuple | None]]:
    """Cells (kind, text, number) of the first sheet's rows; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheet = first_sheet(z)
        if sheet is None:
            return
        strings = _elements(z, "xl/sharedStrings.xml", "si") if "xl/sharedStrings.xml" in z.namelist() else ()
        shared = ["".join(t.text or "" for t in si.iter(_NS + "t")) for si in strings]
        dates, at = date_styles(z), 0
        for row in _elements(z, sheet, "row"):
            number = int(row.get("r", at + 1)) - 1
            while at < number:
                yield []
                at += 1
            cells: list[tuple | None] = []
            for c in row.iter(_NS + "c"):
                place = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (place - len(cells))
                cells.append(_cell(c, shared, dates))
            yield cells
            at += 1


#: Parts of a document: its check (``texto`` is null or says what is wrong), lines, lines of its header, rows of cells, and notes on what couldn't be read.
PARTES = ("control", "linea", "cabecera", "celda", "nota")
PARTS = "doc_id string, parte string, linea int, texto string, cells array<struct<kind: string, s: string, d: double>>"
SHEET_HEADER, PAGE_HEADER = 15, 40

Part = tuple[str, int | None, str | None, list[tuple] | None]


def _cell_text(cell: tuple) -> str:
    return cell[1] if cell[1] is not None else str(cell[2])


def file_parts(content: bytes, suffix: str, pages: Callable[[bytes], list[str]] | None = None, want: tuple[str, ...] = PARTES) -> Iterator[Part]:
    """(parte, linea, texto, cells) of one file, all from one look at its bytes.

    A file that fails its check has nothing else; a part that can't be read is a note, never an error.
    """
    wrong = check(content, suffix)
    yield "control", None, wrong, None
    if wrong or not set(want) - {"control"}:
        return
    try:
        if suffix == "txt":
            text = content.decode("utf-8", "replace")
            for i, line in enumerate(re.split(r"\r?\n", text) if text.strip(" ") else ()):
                yield "linea", i, line, None
                yield "cabecera", i, line, None
        elif suffix == "pdf" and pages is not None:
            found = [p if p and p.strip() else "" for p in pages(content)]
            for i, line in enumerate(x for p in found if p for x in p.split("\n")):
                yield "linea", i, line, None
            for i, line in enumerate((found[0].split("\n") if found and found[0] else [])[:PAGE_HEADER]):
                yield "cabecera", i, line, None
        elif suffix in ("xlsx", "xlsm"):
            for i, row in enumerate(sheet_rows(content)):
                yield "celda", i, None, [c or (None, None, None) for c in row]
                if i < SHEET_HEADER:
                    yield "cabecera", i, " ".join(_cell_text(c) for c in row if c), None
    except Exception as e:  # whatever a file or the caller's backend brings up concerns that file alone
        yield "nota", None, f"LECTURA INCOMPLETA: {type(e).__name__}: {e}", None


def document_parts(files: DataFrame, pages: Callable[[bytes], list[str]] | None = None, want: tuple[str, ...] = PARTES) -> DataFrame:
    """``PARTS`` of all files (doc_id, content, suffix): each is opened once, whatever is wanted of it. Cut the result where it is used more than once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, content, suffix in zip(b["doc_id"], b["content"], b["suffix"]):
                rows = (r for r in file_parts(bytes(content), suffix, pages, want) if r[0] in want)
                while chunk := list(islice(rows, 10_000)):
                    cells = [None if r[3] is None else [dict(zip(("kind", "s", "d"), c)) for c in r[3]] for r in chunk]
                    yield pd.DataFrame({"doc_id": doc, "parte": [r[0] for r in chunk], "linea": pd.array([r[1] for r in chunk], "Int32"), "texto": [r[2] for r in chunk], "cells": cells})

    return files.select("doc_id", "content", "suffix").mapInPandas(run, PARTS)


def lines_of(parts: DataFrame, part: str = "linea") -> DataFrame:
    """(doc_id, linea, texto) of one kind of parts."""
    return parts.where(F.col("parte") == part).select("doc_id", "linea", "texto")


def cells_of(parts: DataFrame) -> DataFrame:
    """(doc_id, linea, cells) of the workbooks; numbered from 0, empty rows kept."""
    return parts.where("parte = 'celda'").select("doc_id", "linea", "cells")


def notes_of(parts: DataFrame) -> DataFrame:
    """(doc_id, notas): what couldn't be read of a document."""
    return parts.where("parte = 'nota'").groupBy("doc_id").agg(F.array_sort(F.collect_list("texto")).alias("notas"))


def spreadsheet_cells(files: DataFrame) -> DataFrame:
    return cells_of(document_parts(files, want=("celda",)))


def header_from_cells(cells: DataFrame, rows: int = SHEET_HEADER) -> DataFrame:
    """(doc_id, linea, texto): the first rows of a sheet as lines, cells joined by blanks."""
    text = F.transform(F.filter("cells", lambda c: c["kind"].isNotNull()), lambda c: F.coalesce(c["s"], c["d"].cast("string")))
    return cells.where(F.col("linea") < rows).select("doc_id", "linea", F.array_join(text, " ").alias("texto"))


def pdf_lines(files: DataFrame, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_id, linea, texto) of PDF files; ``pages`` gives the text of each page (a text or OCR backend of the user's).

    Blank pages contribute nothing; lines are numbered over all pages.
    """
    return lines_of(document_parts(files.where("suffix = 'pdf'"), pages, ("linea",)))
