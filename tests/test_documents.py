import io
import json
import re
import zipfile

import pytest

from saldospark.operators import feedback as H
from saldospark.operators import metadata as M
from saldospark.operators import parse as P
from saldospark.operators import profile as R
from saldospark.plans import queries as Q
from saldospark.plans import statement
from saldospark.rules import special
from saldospark.sources import files, tables
from saldospark.streaming import ingest


def lines(spark, docs):
    return spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id string, linea int, texto string")


def profile(spark, fmt, sep="."):
    return spark.createDataFrame([("d", fmt, sep, 1.0)], "doc_id string, formato_codigo string, separador_miles string, confianza_base double")


@pytest.mark.parametrize("line, fmt, want", [
    ("1-01-01 Caja 1.000 0 1.000 0 1.000 0 0 0", "guion", ("1-01-01", "Caja", 1000.0, "activo", False)), ("1-01-01 Caja 500", "guion", ("1-01-01", "Caja", 500.0, "activo", False)),
    ("Caja 100 - - -", "sin_codigo", (None, "Caja", 100.0, "activo", False)), ("Total Activos 900", "sin_codigo", (None, "Total Activos", 900.0, "activo", True)),
    ("1-01-01 Caja", "guion", ("1-01-01", "Caja", None, "desconocido", False)), ("ab", "guion", None), ("Servicio de aseo 0 0 0 0", "sin_codigo", (None, "Servicio de aseo", 0.0, "activo", False)),
    ("3.01.01 Capital social $500", "sin_codigo", ("3.01.01", "Capital social", 500.0, "pasivo", False)), ("1,01,01 Caja 5 O", "punto", ("1.01.01", "Caja", 5.0, "activo", False)),
])
def test_line(spark, line, fmt, want):
    got = P.parse_lines(lines(spark, {"d": [line]}), profile(spark, fmt)).collect()
    assert [(r["codigo"], r["nombre"], r["monto"], r["origen_columna"], r["es_total"]) for r in got] == ([want] if want else [])


def by_hand(line, fmt, sep):
    """A line-by-line version with plain Python, to hold the column expressions against."""
    head = re.match(r"(\d{1,2}[.,]){2,4}\d{1,2}(?=\s)", line)
    line = (line[: head.end()].replace(",", ".") + line[head.end():]).strip() if head else line.strip()
    if len(line) < 4:
        return None
    code, rest = None, line
    for f in [fmt] if fmt in P.LINE_CODES else ["punto", "guion", "compacto"]:
        if m := re.match(P.LINE_CODES[f], line):
            code, rest = m.groups()
            break
    words = rest.split()
    for _ in range(2):
        if words and not re.search(r"\d", words[-1]) and len(words[-1]) <= 2:
            words.pop()
    sums = []
    while words:
        w = "0" if words[-1] in ("o", "O", "-") else words[-1].replace("$", "")
        if not re.fullmatch(R.AMOUNT, w):
            break
        sums.insert(0, w)
        words.pop()
    name = " ".join(words).strip(" .-")
    if len(name) < 3:
        return None

    def number(v):
        if v in ("0", "0.00", "0,00"):
            return 0.0
        neg = v.startswith("(") and v.endswith(")")
        v = v[1:-1] if neg else v
        neg, v = neg or v.startswith("-"), v[1:] if v.startswith("-") else v
        try:
            x = float(v.replace(".", "").replace(",", ".") if sep == "." else v.replace(",", ""))
        except ValueError:
            return None
        return -x if neg else x

    found = [number(s) for s in sums]
    origin, amount = "desconocido", None
    if len(found) >= 4:
        hit = next(((v, o) for v, o in zip(found[-4:], P.COLUMNS) if v), None)
        amount, origin = hit or (found[-4], "activo")
    elif found:
        amount = next((v for v in reversed(found) if v), found[-1])
        root = code.translate({46: None, 45: None})[0] if code else ""
        capital = "capital" in name.lower() or "patrimonio" in name.lower()
        origin = {"1": "activo", "2": "pasivo", "3": "pasivo" if capital else "perdida", "4": "perdida", "5": "ganancia"}.get(root)
        origin = origin or next((o for o, ws in special.COLUMN_WORDS.items() if any(w in name.lower() for w in ws)), "desconocido")
    return code, name, amount, origin


def test_parse_lines_equals_line_by_line(spark, sf_dir):
    rendered = Q._lines(spark, sf_dir).where("doc_id <= 6")
    profiles = {r["doc_id"]: r for r in R.profile(rendered).collect()}
    want = {(r["doc_id"], r["linea"]): by_hand(r["texto"], profiles[r["doc_id"]]["formato_codigo"], profiles[r["doc_id"]]["separador_miles"]) for r in rendered.collect()}
    got = {(r["doc_id"], r["linea"]): (r["codigo"], r["nombre"], r["monto"], r["origen_columna"]) for r in P.parse_lines(rendered).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_profile(spark):
    docs = {"a": ["1-01-01 Caja 1.000", "1-01-02 Banco 2.000,5", "x"], "b": ["", " "], "c": ["1.1.1 Caja 1,000.50", "1.1.2 Caja 2,000.5", "111111 X 1"]}
    got = {r["doc_id"]: (r["formato_codigo"], r["separador_miles"]) for r in R.profile(lines(spark, docs)).collect()}
    assert got["a"] == ("guion", ".") and got["b"] == ("sin_codigo", ".") and got["c"][0] == "punto"
    ranked = spark.createDataFrame([("d", 0, 5), ("d", 90, 5), ("e", 0, 1), ("e", 90, 4)], "doc_id string, rotacion int, palabras int")
    assert {r["doc_id"]: r["rotacion"] for r in R.best_rotation(ranked).collect()} == {"d": 0, "e": 90}


def test_metadata(spark):
    docs = {
        "kame": ["INGEFIRE SPA", "RUT: 76.693.319-K", "Balance Desde 01/01/2023 hasta 31/12/2023"], "dsi": ["Empresa: DESARROLLO DE SOLUCIONES INTEGRALES CHILE SPA", "76437956-K", "al 31 de diciembre de 2023"],
        "inmo": ["Razón Social: INMOBILIARIA RUIZ S.A.", "R.U.T. 76.635.890-K", "Giro: arriendo bienes inmuebles", "Ejercicio 2023"], "none": ["12345", "fecha 1"],
    }
    got = {r["doc_id"]: r for r in M.extract_metadata(lines(spark, docs)).collect()}
    assert tuple(got["kame"])[1:] == ("76.693.319-K", "Ingefire Spa", "01/01/2023", "31/12/2023", None, 1.0)
    assert tuple(got["dsi"])[1:] == ("76437956-K", "Desarrollo De Soluciones Integrales Chile Spa", "01/01/2023", "31/12/2023", None, 1.0)
    assert tuple(got["inmo"])[1:] == ("76.635.890-K", "Inmobiliaria Ruiz S.A.", "01/01/2023", "31/12/2023", "Arriendo Bienes Inmuebles", 1.0)
    assert tuple(got["none"])[1:] == (None, None, None, None, None, 0.0)


def workbook(rows):
    shared = ['<si><t>Caja</t></si>']
    cells = "".join(f'<row r="{i + 1}">' + "".join(c for c in r) + "</row>" for i, r in rows)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    book = workbook([(0, ['<c r="A1" t="inlineStr"><is><t>1.01.01</t></is></c>', '<c r="B1" t="s"><v>0</v></c>', '<c r="D1"><v>12.5</v></c>', '<c r="E1"><v>7</v></c>']), (2, ['<c r="B3" t="inlineStr"><is><t>Banco Estado</t></is></c>'])])
    for name, data in (("a.xlsx", book), ("b.xlsx", b"\0" * 10), ("c.xlsx", b"zip?"), ("d.pdf", b"%PDF-1"), ("e.pdf", b"nope"), ("f.xls", bytes.fromhex("D0CF11E0A1B11AE1")), ("g.txt", b"x"), ("h.xls", b"")):
        (tmp_path / name).write_bytes(data)
    found = files.binary_files(spark, str(tmp_path))
    ok = {r["doc_id"].rsplit("/", 1)[-1]: r["valido"] for r in files.check_files(found, spark.createDataFrame([(f"{tmp_path.as_uri()}/h.xls".replace("file:///", "file:/"),)], "doc_id string")).collect()}
    assert ok == {"a.xlsx": True, "b.xlsx": False, "c.xlsx": False, "d.pdf": True, "e.pdf": False, "f.xls": True, "g.txt": True, "h.xls": False}
    cells = files.spreadsheet_cells(found.where("doc_id like '%a.xlsx'"))
    got = [(r["linea"], r["codigo"], r["nombre"], r["monto"], r["confianza_extraccion"]) for r in P.parse_cells(cells).orderBy("linea").collect()]
    assert got == [(0, None, "1.01.01", 7.0, 0.9), (2, None, "Banco Estado", None, 0.9)]  # the code is the longest text, so it is the name
    assert [r["texto"] for r in files.header_from_cells(cells).orderBy("linea").collect()] == ["1.01.01 Caja 12.5 7.0", "", "Banco Estado"]
    pdf = files.pdf_lines(found, lambda content: ["uno\ndos", " ", "tres"])
    assert [r["texto"] for r in pdf.where("doc_id like '%d.pdf'").orderBy("linea").collect()] == ["uno", "dos", "tres"]


def test_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"AC.01": {"codigo_estandar": "AC.01", "nombre_estandar": "Caja", "signo_normal": 1, "es_deuda_financiera": False, "descripcion": "d"}}))
    (tmp_path / "d.json").write_text(json.dumps([{"cuenta_original": "Caja", "codigo_estandar": "AC.01", "fuente": "m"}, {"cuenta_original": "CAJA", "codigo_estandar": "AC.02", "fuente": "m"}]))
    assert tables.read_catalog_json(spark, str(tmp_path / "c.json")).first()["descripcion"] == "d"
    dic = tables.read_dictionary_json(spark, str(tmp_path / "d.json"))
    assert [r["codigo_estandar"] for r in tables.as_stored(dic).collect()] == ["AC.02"]
    tables.write_dictionary_json(dic, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("1-01-01 Caja 500\n1-01-04 Clientes 700\n")
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["nombre"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Caja", "Clientes"]


def result(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, linea int, nombre_original string, codigo_clasificado string, metodo string, confianza double, requiere_revision boolean")


def test_propagation_is_idempotent_and_order_free(spark):
    rows = [(1, 0, "X Y", "", "s", 0.0, True), (1, 1, "x  y", "AC.02", "m", 0.9, False), (2, 0, "X y", "AC.01", "m", 0.9, False), (2, 1, "x y", "", "s", 0.0, True), (3, 0, "", "", "s", 0.0, True), (3, 1, None, "", "s", 0.0, True),
            (4, 0, "z", "__EXCLUIR__", "m", 1.0, False), (4, 1, "z", "", "s", 0.0, True)]
    once = H.propagate_labels(result(spark, rows))
    want = sorted(map(tuple, once.collect()), key=str)
    assert sorted(map(tuple, H.propagate_labels(once).collect()), key=str) == want
    assert sorted(map(tuple, H.propagate_labels(result(spark, rows[::-1]).repartition(3)).collect()), key=str) == want
    assert {(r[0], r[1]): r[3] for r in want} == {(1, 0): "AC.02", (1, 1): "AC.02", (2, 0): "AC.01", (2, 1): "AC.02", (3, 0): "", (3, 1): "", (4, 0): "__EXCLUIR__", (4, 1): ""}


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([("k", 1, 1), ("l", 1, 1)], "key string, v int, seq int")
    b = spark.createDataFrame([("k", 2, 2), ("n", 3, 3)], "key string, v int, seq int")
    once = H.upsert(a, b, "key")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, H.upsert(once, b, "key").collect())) == [("k", 2, 2), ("l", 1, 1), ("n", 3, 3)]


def test_export_name(spark):
    meta = spark.createDataFrame([("d", "Ruiz S.A.", "76.635.890-K"), ("e", None, None)], "doc_id string, razon_social string, rut string")
    assert {r["doc_id"]: r["archivo"] for r in tables.export_name(meta).collect()} == {"d": "Balance_Unificado-Ruiz_S_A_-76635890K", "e": "Balance_Unificado-Empresa-"}


def test_cells_by_type_and_sheet_order():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="B" sheetId="2" r:id="rId7"/><sheet name="A" sheetId="1" r:id="rId3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId3" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="worksheets/sheet10.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yy"/><numFmt numFmtId="171" formatCode="#,##0 &quot;dias&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>")
        cells = '<c t="e"><v>#DIV/0!</v></c><c t="b"><v>1</v></c><c s="1"><v>45000</v></c><c s="2"><v>45000.5</v></c><c s="3"><v>7</v></c><c t="d"><v>2024-01-31</v></c><c t="s"><v>99</v></c><c><v>no number</v></c><c t="str"><v>x</v></c><c/>'
        z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {ns}><sheetData><row>{cells}</row></sheetData></worksheet>")
    assert list(files.sheet_rows(out.getvalue())) == [[None, ("n", None, 1.0), ("d", "45000", None), ("d", "45000.5", None), ("n", None, 7.0), ("d", "2024-01-31", None), None, None, ("s", "x", None), None]]


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("INGEFIRE SPA\n1-01-01 Caja 500\n2-01-01 Proveedores 300\n")
    (tmp_path / "b.xlsx").write_bytes(workbook([(0, ['<c r="A1" t="inlineStr"><is><t>Banco Estado</t></is></c>', '<c r="B1"><v>12.5</v></c>'])]))
    (tmp_path / "c.xlsx").write_bytes(b"zip?")
    (tmp_path / "d.txt").write_text(" ")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1")
    got = statement.read_documents(spark, str(tmp_path), lambda content: ["Empresa: X SPA\n1-01-02 Banco 700", "1-01-03 Clientes 900"])
    short = lambda d: d.rsplit("/", 1)[-1]
    assert sorted((short(r["doc_id"]), r["nombre"], r["monto"]) for r in got.cuentas.collect()) == [
        ("a.txt", "Caja", 500.0), ("a.txt", "INGEFIRE SPA", None), ("a.txt", "Proveedores", 300.0), ("b.xlsx", "Banco Estado", 12.5),
        ("e.pdf", "Banco", 700.0), ("e.pdf", "Clientes", 900.0), ("e.pdf", "Empresa: X SPA", None)]
    notes = {short(r["doc_id"]): (r["valido"], r["advertencias"]) for r in got.perfiles.collect()}
    assert notes["b.xlsx"] == (True, []) and notes["d.txt"] == (True, ["No se pudo extraer texto (ni nativo ni OCR)"]) and notes["c.xlsx"][0] is False
    assert notes["c.xlsx"][1] == ["VALIDACIÓN FALLIDA: Archivo .xlsx corrupto: no es un ZIP válido"] and notes["a.txt"][1][0].startswith("CONTROL DE CUADRE FALLIDO: Activos (500)")
    assert {short(r["doc_id"]): r["razon_social"] for r in got.metadatos.collect()} == {"a.txt": "Ingefire Spa", "b.xlsx": "Banco Estado 12.5", "e.pdf": "X Spa"}


def test_load_and_fallback(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS carga LOCATION '" + str(tmp_path / "db") + "'")
    one = {"codigo_estandar": "AC.01", "nombre_estandar": "Caja", "signo_normal": 1}
    (tmp_path / "c.json").write_text(json.dumps({"AC.01": one}))
    (tmp_path / "d.json").write_text(json.dumps([{"cuenta_original": "Caja", "codigo_estandar": "AC.01", "fuente": "m"}, {"cuenta_original": "CAJA", "codigo_estandar": "AC.02", "fuente": "m"}]))
    for _ in range(2):
        assert tables.load(spark, str(tmp_path / "c.json"), str(tmp_path / "d.json"), "carga") == (1, 1)
    (tmp_path / "c.json").write_text(json.dumps({"AC.01": one | {"nombre_estandar": "Efectivo"}, "AC.02": one | {"codigo_estandar": "AC.02"}}))
    assert tables.load(spark, str(tmp_path / "c.json"), str(tmp_path / "d.json"), "carga") == (2, 1)
    assert {r["codigo_estandar"]: r["nombre_estandar"] for r in spark.table("carga.catalogo_maestro").collect()} == {"AC.01": "Efectivo", "AC.02": "Caja"}
    spark.sql("DROP DATABASE carga CASCADE")
    absent = lambda: spark.table("carga.catalogo_maestro")
    assert tables.read_or_empty(absent, lambda: tables.read_catalog_json(spark, str(tmp_path / "c.json"))).count() == 2
    assert tables.read_or_empty(absent, lambda: spark.read.text(str(tmp_path / "no.json"))).count() == 0
    with pytest.raises(ZeroDivisionError):
        tables.read_or_empty(lambda: 1 / 0)


def test_export(spark, tmp_path):
    meta = spark.createDataFrame([("d", "X SPA", None, "01/01/2023", None, None)], "doc_id string, razon_social string, rut string, periodo_desde string, periodo_hasta string, giro string")
    assert [tuple(r) for r in tables.export_header(meta).collect()] == [("d", 1, "Empresa:", "X SPA"), ("d", 2, "RUT:", ""), ("d", 3, "Período:", "01/01/2023 al "), ("d", 4, "Giro:", "")]
    rows = spark.createDataFrame([("AC.01", None)], "codigo string, monto double")
    tables.write_statement(rows, str(tmp_path / "out"), rows, meta)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["balance", "detalle", "encabezado"]
    assert tables.as_json(rows).first()["json"] == '{"codigo":"AC.01","monto":null}'


def broken_sheet():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="inlineStr"><is><t>Caja</t></is></c><c><v>5</v></c></row><row><c>')
    return out.getvalue()


def put_documents(folder):
    (folder / "a.txt").write_text("INGEFIRE SPA\r\n1-01-01 Caja 500\n2-01-01 Proveedores 300\n")
    (folder / "b.xlsx").write_bytes(workbook([(0, ['<c r="A1" t="inlineStr"><is><t>Banco Estado</t></is></c>', '<c r="B1"><v>12.5</v></c>'])]))
    (folder / "broken.xlsx").write_bytes(broken_sheet())
    (folder / "torn.pdf").write_bytes(b"%PDF-1 bad")
    (folder / "whole.pdf").write_bytes(b"%PDF-1")
    (folder / "no.xlsx").write_bytes(b"zip?")


def test_each_file_is_read_once_and_errors_are_notes(spark, tmp_path):
    marks, docs = tmp_path / "marks", tmp_path / "docs"
    marks.mkdir(), docs.mkdir()
    put_documents(docs)
    where = str(marks)

    def pages(content):
        """A text backend for PDF files that leaves a mark for each call."""
        import uuid

        open(f"{where}/{uuid.uuid4().hex}", "w").close()
        if b"bad" in content:
            raise OSError("page 1 is torn")
        return ["Empresa: X SPA\n1-01-02 Banco 700", "1-01-03 Clientes 900"]

    got = statement.read_documents(spark, str(docs), pages)
    short = lambda d: d.rsplit("/", 1)[-1]
    notes = {short(r["doc_id"]): list(r["advertencias"]) for r in got.perfiles.collect()}
    accounts = {(short(r["doc_id"]), r["nombre"]) for r in got.cuentas.collect()}
    got.metadatos.collect(), got.perfiles.collect()
    assert len(list(marks.iterdir())) == 2  # one call for each PDF file, whatever was collected
    assert notes["broken.xlsx"][0].startswith("LECTURA INCOMPLETA: ParseError") and "LECTURA INCOMPLETA: OSError: page 1 is torn" in notes["torn.pdf"] and notes["no.xlsx"][0].startswith("VALIDACIÓN FALLIDA")
    assert {("broken.xlsx", "Caja"), ("whole.pdf", "Clientes"), ("a.txt", "Caja"), ("b.xlsx", "Banco Estado")} <= accounts


def test_data_source_equals_the_binary_reader(spark, tmp_path):
    from saldospark.sources import documents

    put_documents(tmp_path)
    documents.register(spark)
    read = lambda **o: spark.read.format(documents.NAME).options(**o).load(str(tmp_path))
    flat = lambda df: sorted(((r["doc_id"].rsplit("/", 1)[-1], *map(str, tuple(r)[1:])) for r in df.collect()), key=str)
    assert flat(read()) == flat(files.document_parts(files.binary_files(spark, str(tmp_path))))
    assert read(group_bytes="1").rdd.getNumPartitions() == 6 and read().rdd.getNumPartitions() == 1
    assert {r["parte"] for r in read(partes="control,nota").collect()} == {"control", "nota"}
    both = read()
    assert both.where("parte = 'linea'").unionByName(both.where("parte = 'control'")).groupBy("parte").count().count() == 2
    from_source = statement.from_parts(read())
    assert {r["nombre"] for r in from_source.cuentas.collect()} == {"INGEFIRE SPA", "Caja", "Proveedores", "Banco Estado"}
