import pytest
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.operators import balance as B
from saldospark.operators import classify as C
from saldospark.rules import catalog, patterns, prefixes
from saldospark.sources.tables import dictionary

CODES = """
1-01-01-02-01 AC.01 0.97 | 1-01-04-01-01 AC.03 0.97 | 1-01-08-01-02 AC.05 0.97 | 2-01-03-01-01 PC.01 0.97 | 2-01-08-01-01 PC.06 0.97
2-01-09-01-01 PC.05 0.97 | 2-02-01-01-01 PNC.01 0.97 | 3-01-01-01-01 PAT.01 0.97 | 4-01-01-01-01 ER.01 0.96 | 5-01-01-01-01 ER.02 0.97
6-01-03-01-01 ER.04 0.95 | 6-01-06-01-01 ER.05 0.95 | 8-01-02-01-02 ER.09 0.95 | 1112001 AC.01 0.97 | 1141001 AC.03 0.95 | 1161001 AC.05 0.97
2131001 PC.01 0.95 | 2171003 PC.05 0.97 | 4111001 ER.01 0.97 | 5111001 ER.02 0.97 | 8121004 ER.09 0.97 | 1.01.01.02 AC.01 0.97 | 1.01.05.01 AC.03 0.97
1.02.03.01 ANC.01 0.97 | 2.01.01.01 PC.02 0.97 | 2.01.07.01 PC.01 0.97 | 2.03.01.01 PAT.01 0.97 | 3.01.01.01 ER.01 0.95 | 4.01.02.01 ER.02 0.95
2020001 PC.01 0.93 | 2010101 PC.02 0.95 | 2010501 PC.05 0.93 | 1-01-99 AC 0.85 | 9999999 None 0 | 12345 None 0 | 1-01 AC 0.85 | 1-01-100-1 AC.07 0.90
"""


def test_codes(spark):
    cases = [e.split() for line in CODES.strip().splitlines() for e in line.split("|")]
    got = {r["codigo"]: (r["cod_codigo"], r["cod_confianza"]) for r in C.by_code_prefix(spark.createDataFrame([(c[0],) for c in cases], "codigo string")).collect()}
    for code, standard, conf in cases:
        assert got[code] == ((None, None) if standard == "None" else (standard, float(conf))), code


def test_two_joins_equal_the_ranked_search(spark):
    """Every listed prefix, tried by falling pattern length, agrees with the two equi-joins."""
    import re

    codes = [p + tail for listed in prefixes.LISTED.values() for pattern, _, _ in listed for p in prefixes.literals(pattern)[-2:] for tail in ("", "00", "-01-02", ".05.06", "1")]
    got = {r["codigo"]: r["cod_codigo"] for r in C.by_code_prefix(spark.createDataFrame([(c,) for c in set(codes)], "codigo string")).collect()}

    def ranked(code):
        fmt = "guion" if re.match(r"\d+-\d+", code) else "punto" if re.match(r"\d+\.\d+", code) else "compacto" if re.fullmatch(r"\d{6,10}", code) else None
        if not fmt:
            return None
        tried = sorted((-len(p), i, p, c) for i, (p, c, _) in enumerate(prefixes.LISTED[fmt]))
        return next((c for _, _, p, c in tried if re.match(p.replace(".", r"\."), code)), None)

    assert {c: ranked(c) for c in got} == got


@pytest.mark.parametrize("name, code, amount, giro, final, flag", [
    ("Banco BCI Cta Cte", "AC.01", -5e6, None, "PC.02", "es_sobregiro"), ("Banco Estado", "AC.01", 1e7, None, None, None),
    ("Terreno Los Andes", "ANC.01", 8e6, "inmobiliaria", "AC.05", "terreno_para_venta"), ("Terreno", "ANC.01", 8e6, "maestranza", None, None),
    ("Ingresos percibidos adelantado", "AC.07", 3e6, None, "PC.08", "era_activo_incorrecto"), ("Anticipo de clientes", "AC.07", 2e6, None, "PC.08", "era_activo_incorrecto"),
    ("Clientes Nacionales", "AC.03", -1.5e6, None, "PC.08", "anticipo_cliente_negativo"), ("Clientes por Obra", "AC.03", 1.5e7, None, None, None),
    ("Cuenta Particular Socio L Fig.", "AC.06", 2.25e7, None, "AC.06S", "ajuste_patrimonio_conservador"), ("Cta Cte Socio los Guris", "AC.06", 1.5e7, None, "AC.06S", "ajuste_patrimonio_conservador"),
    ("Dividendos Provisorios", "PAT.04", 1e7, None, "AC.06S", "ajuste_patrimonio_conservador"), ("Distribuciones", "AC.06", 5e6, None, None, None),
    ("Banco", "AC.01", None, None, None, None), ("Terreno", "ANC.01", 1.0, "Construcción", None, None),
])
def test_special_rules(spark, name, code, amount, giro, final, flag):
    df = spark.createDataFrame([(name, code, amount, giro)], "n string, c string, m double, g string")
    r = df.select(C.special_rule(C.name_marks(F.col("n")), F.col("c"), F.col("m"), F.col("g")).alias("r")).first()["r"]
    assert (r["codigo_final"], r["flag"]) == (final, flag) if final else r is None


@pytest.mark.parametrize("name, code", [("leasing lp", "PC.03"), ("obligaciones bancarias lp", "PC.02"), ("gastos de ventas", "ER.01"), ("costo de ventas", "ER.02"), ("impuesto a la renta", "ER.10"),
                                        ("anticipo de clientes", "AC.03"), ("anticipo proveedor", "PC.01"), ("prestamo bancario", None), ("bancos", None), ("MERCADERÍA", "AC.05")])
def test_regex_rules(spark, name, code):
    r = spark.createDataFrame([(name,)], "n string").select(C.regex_rule(F.col("n")).alias("r")).first()["r"]
    assert (r["code"] if r else None) == code


def test_catalog(spark):
    rows = {r["codigo_estandar"]: r for r in catalog.catalog(spark).collect()}
    assert len(rows) == 52 and len(patterns.RULES) == 37 and sum(map(len, prefixes.LISTED.values())) == 129
    assert (rows["ER.02"]["naturaleza"], rows["ER.02"]["signo_normal"], rows["ER.02"]["afecta_ebitda"]) == ("deudora", -1, True)
    assert (rows["PC.04"]["signo_normal"], rows["PC.04"]["es_deuda_financiera"], rows["AC.02"]["es_activo_liquido"]) == (-1, True, True)


def test_column_correction_falls_through(spark):
    df = spark.createDataFrame([("interes por servicio", "ER.12", "ganancia", 1.0), ("arriendo", "ER.02", "perdida", 1.0), ("banco", "AC.01", "activo", -1.0), ("reajuste", "ER.14", "ganancia", 1.0)], "n string, c string, o string, m double")
    got = [r[0] for r in df.select(C.column_correction(F.col("n"), F.col("c"), F.col("o"), F.col("m"))).collect()]
    assert got == ["ER.01", "ER.04", "PC.02", None]


def test_cascade_steps(spark):
    accounts = spark.createDataFrame([
        ("d", 0, None, "Intereses", 5.0, "ganancia", False), ("d", 1, "1-01-04-01", "Deudores", 5.0, "desconocido", False), ("d", 2, None, "Caja  General", 5.0, "desconocido", False),
        ("d", 3, None, "General de Caja", 5.0, "desconocido", False), ("d", 4, None, "Vehículos", 5.0, "desconocido", False), ("d", 5, None, "???", 5.0, "desconocido", False),
        ("d", 6, None, "Retiro de socio X", 5.0, "desconocido", False), ("d", 7, None, None, None, "activo", False), ("d", 8, "4-01-01", "Arriendo oficina", 5.0, "perdida", False),
    ], "doc_id string, linea int, codigo string, nombre string, monto double, origen_columna string, es_total boolean")
    dic = dictionary(spark, [("Caja de General", "AC.01", "a"), ("caja general", "AC.02", "b"), ("Caja General", "AC.01", "c")])
    got = {r["linea"]: (r["codigo_clasificado"], r["metodo"], round(r["confianza"], 3), r["requiere_revision"]) for r in C.classify(accounts, dic).collect()}
    assert got[0] == ("ER.12", "columna_ambiguo", 0.88, False)
    assert got[1] == ("AC.03", "codigo", 0.97, False)
    assert got[2] == ("AC.01", "diccionario_exacto", 0.98, False)
    assert got[3] == ("AC.01", "diccionario_fuzzy", 0.9, False)
    assert got[4] == ("ANC.01", "regla_regex", 0.9, False)
    assert got[5] == ("", "sin_clasificar", 0.0, True)
    assert got[6] == ("AC.06S", "regla_regex+regla_especial(ajuste_patrimonio_conservador)", 0.93, False)
    assert got[7] == ("", "sin_clasificar", 0.0, True)
    assert got[8] == ("ER.01", "codigo", 0.96, False)


def test_equity_example(spark):
    rows = [("PAT.01", 50e6), ("PAT.02", 5e6), ("PAT.03", 80e6), ("PAT.04", 33e6), ("PAT.05", 9e9), ("AC.06S", 22.5e6)]
    df = spark.createDataFrame([("d", c, m, False) for c, m in rows], "doc_id string, codigo_clasificado string, monto double, es_total boolean")
    assert tuple(B.effective_equity(df).first()) == (168e6, 22.5e6, 145.5e6, True, False)


@pytest.mark.parametrize("value, sep, want", [("(1.234,50)", ".", -1234.5), ("1,234.50", ",", 1234.5), ("-", ".", None), ("", ".", None), ("0,00", ".", 0.0), ("(5", ".", None), ("--5", ".", 5.0), ("(-5)", ".", -5.0),
                                              ("-(5)", ".", None), ("1d", ",", None), (None, ".", None), (" 7 ", ".", 7.0), ("()", ".", None)])
def test_amounts(spark, value, sep, want):
    assert spark.createDataFrame([(value,)], "v string").select(T.parse_amount(F.col("v"), sep)).first()[0] == want


def test_separator_votes(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ("1.234.567", "12,5", "1.234,50", "1,234.5", "12.5", "1.2.3", "-", "0", "1,234", ".")], "v string").select(T.separator_vote(F.col("v"))).collect()]
    assert got == [".", None, ".", ",", None, ".", None, None, ",", "."]


def test_names_and_similarity(spark):
    df = spark.createDataFrame([("  Ñandú & Cía. S.A.\t",)], "v string")
    assert df.select(T.normalize_name(F.col("v"))).first()[0] == "ñandú cía s a"
    assert df.select(T.title_case(F.lit("ruiz s.a. y cia ltda."))).first()[0] == "Ruiz S.A. Y Cia Ltda."
    assert df.select(T.lcs_length(F.lit("bancos de chile"), F.lit("banco chile"))).first()[0] == 11
    assert df.select(T.similarity(F.lit("kitten"), F.lit("sitting"))).first()[0] == pytest.approx(200 * 4 / 13)
    assert df.select(T.similarity(F.lit(""), F.lit("x"))).first()[0] == 0
