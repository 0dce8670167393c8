import json
import math
import random

import pytest
from pyspark.sql import functions as F

from saldospark import __main__ as command
from saldospark.functions import tables as table_functions
from saldospark.operators import balance as B
from saldospark.operators import risk, terms
from saldospark.rules.catalog import SECTIONS, catalog
from saldospark.sources import ordered, tables
from saldospark.sources.tables import dictionary


def test_files_give_the_total_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i, rng.choice([None, rng.random()])) for i in range(5_000)]
    df = spark.createDataFrame(rows, "a int, b int, c double").repartition(6)
    order = [F.col("a"), F.abs("c").desc_nulls_last(), F.col("b")]
    ordered.write_ordered(df, str(tmp_path / "t"), order, files=5)
    assert len(list((tmp_path / "t").glob("part-*.parquet"))) == 5
    want = sorted(rows, key=lambda r: (r[0], r[2] is None, -(r[2] or 0), r[1]))
    got = ordered.read_places(spark, str(tmp_path / "t")).orderBy("lugar").collect()
    assert [tuple(r)[:3] for r in got] == want and [r["lugar"] for r in got] == list(range(1, 5_001))
    assert ordered.out_of_order(spark, str(tmp_path / "t"), [F.col("a")]).count() == 0
    assert ordered.out_of_order(spark, str(tmp_path / "t"), [-F.col("a")]).count() == 49
    ordered.write_ordered(df.limit(0), str(tmp_path / "none"), order)
    assert ordered.read_places(spark, str(tmp_path / "none")).count() == 0


def test_statement_detail_is_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"AC.{i % 7:02d}", float((i * 37) % 101 - 50), i, 0) for i in range(300)], "codigo_clasificado string, monto double, doc_id int, linea int")
    tables.write_statement(rows.limit(2), str(tmp_path), rows, detail_order=B.detail_order(), files=3)
    lines = [line for p in sorted((tmp_path / "detalle").glob("part-*.csv")) for line in p.read_text().splitlines()[1:]]
    keys = [(c, -abs(float(m)), int(d)) for c, m, d, _ in (x.split(",") for x in lines)]
    assert len(keys) == 300 and keys == sorted(keys)


def test_sections_leave_out_empty_categories(spark):
    rows = [("d", c, m, False, "x") for c, m in (("PAT.01", 5.0), ("AC.01", 1.5), ("AC.03", 2.5), ("ZZ.1", 9.0), ("", 3.0))]
    got = B.balance_sections(spark.createDataFrame(rows, "doc_id string, codigo_clasificado string, monto double, es_total boolean, nombre_original string"), catalog(spark)).orderBy("orden", "codigo").collect()
    assert [(r["titulo"], r["codigo"], r["subtotal"]) for r in got] == [(SECTIONS[0], "AC.01", 4.0), (SECTIONS[0], "AC.03", 4.0), (SECTIONS[4], "PAT.01", 5.0)]


def test_sketches_merge_within_the_error(spark):
    rng = random.Random(3)
    values = [(g, rng.lognormvariate(10, 2)) for g in "ab" for _ in range(20_000)] + [("c", 7.0)] * 500 + [("d", 1.0)]
    df = spark.createDataFrame(values, "giro string, retiro double").repartition(7)
    parts = risk.sketches(df.where("retiro < 20000")).unionByName(risk.sketches(df.where("retiro >= 20000")))
    for r in risk.quantiles(risk.merged(parts)).collect():
        held = sorted(v for g, v in values if g == r["giro"])
        assert r["n"] == len(held) and r["limite"] == pytest.approx(r["q3"] + 3 * (r["q3"] - r["q1"]))
        for c, p in (("q1", 0.25), ("mediana", 0.5), ("q3", 0.75)):
            below, upto = sum(v < r[c] for v in held) / len(held), sum(v <= r[c] for v in held) / len(held)
            assert below - risk.RANK_ERROR <= p <= upto + risk.RANK_ERROR + 1 / len(held)


def test_committee_alerts(spark):
    rows = [("d", 0, "Tecnologia", "ER.01", 105e6, False), ("d", 1, "Tecnologia", "AC.06S", 25e6, False), ("d", 2, "Tecnologia", "AC.06S", 1e6, False), ("e", 0, "Construcción de obras", "ER.01", 1e6, False), ("f", 0, None, "AC.06S", None, False)]
    df = spark.createDataFrame(rows, "doc_id string, linea int, giro string, codigo_clasificado string, monto double, es_total boolean")
    declared = spark.createDataFrame([("d", 100e6), ("e", 1e6)], "doc_id string, ventas_anuales double")
    limits = spark.createDataFrame([("Tecnologia", 2e7), ("", 0.0)], "giro string, limite double")
    got = sorted((r["doc_id"], r["tipo"], r["orden"], r["alerta"]) for r in risk.alerts(df, declared, limits).collect())
    assert got == sorted([
        ("d", "ventas", 0, "Ventas del balance (105,000,000) se desvían de las declaradas (100,000,000)"), ("d", "retiro", 1, "Retiro de socios (25,000,000) sobre el límite del giro (20,000,000)"),
        *[("e", "giro", i, t) for i, t in enumerate(risk.NOTES["construccion"])]])


def cosine_by_hand(names, known):
    grams = lambda s: {f" {s} "[i:i + 3] for i in range(len(s))}
    df = {}
    for k in known:
        for g in grams(k):
            df[g] = df.get(g, 0) + 1
    weigh = lambda s: {g: math.log((1 + len(known)) / (1 + df.get(g, 0))) + 1 for g in grams(s)}
    out = {}
    for n in names:
        a = weigh(n)
        for k in known:
            b = weigh(k)
            c = round(sum(a[g] * b[g] for g in a.keys() & b.keys()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9)
            if c >= 0.5:
                out.setdefault(n, []).append((-c, k))
    return {n: (min(v)[1], -min(v)[0]) for n, v in out.items()}


def test_open_names_equal_all_pairs(spark):
    rng = random.Random(5)
    words = "caja chica banco fondo fijo cliente nacional deudor varios obra en curso costo ventas renta".split()
    known = sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(120)} | {"x", "ab"})
    names = sorted({" ".join(rng.sample(words, rng.randrange(1, 4)))[: rng.randrange(1, 30)].strip() for _ in range(120)} | {"x", "ab", "zzzz"})
    got = terms.matches(spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "nombre_norm string"), spark.createDataFrame([(k, f"c{i}") for i, k in enumerate(known)] + [("", "no")], "clave string, codigo string")).collect()
    want = cosine_by_hand([n for n in names if n], known)
    assert {r["nombre_norm"]: (r["parecido"], pytest.approx(r["coseno"], abs=2e-9)) for r in got} == want
    assert all(r["codigo"] == f"c{known.index(r['parecido'])}" for r in got)


def test_suggestions_for_open_rows(spark):
    rows = [("Fondo por rendir caja", ""), ("fondo por rendir  caja", ""), ("Caja", "AC.01"), ("qqq", ""), (None, "")]
    dic = dictionary(spark, [("Fondos por rendir", "AC.07", "m"), ("FONDOS POR RENDIR", "AC.08", "m")])
    got = terms.suggest(spark.createDataFrame(rows, "nombre_original string, codigo_clasificado string"), dic, catalog(spark)).collect()
    assert [(r["nombre_norm"], r["parecido"], r["codigo"], r["filas"]) for r in got] == [("fondo por rendir caja", "fondos por rendir", "AC.08", 2)]


def test_table_function_in_a_lateral_join(spark):
    table_functions.register(spark)
    docs = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "d int, t string")
    got = spark.sql("SELECT d, linea, contenido FROM {docs} x, LATERAL document_lines(x.t)", docs=docs).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "")]


def test_command_lines(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("1-01-01 Caja 500\n2-01-01 Total Pasivos 300\n")
    assert command.main(["parse", str(tmp_path / "docs"), "--out", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "Formato código: guion" in said and "Total cuentas extraídas: 2" in said and "[1-01-01           ] Caja" in said and "[TOTAL]" in said
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"AC.01": {"codigo_estandar": "AC.01", "nombre_estandar": "Caja"}}))
    (tmp_path / "d.json").write_text(json.dumps([{"cuenta_original": "Caja", "codigo_estandar": "AC.01", "fuente": "m"}]))
    spark.sql(f"CREATE DATABASE ordenes LOCATION '{tmp_path / 'db'}'")
    try:
        assert command.main(["load", str(tmp_path / "c.json"), str(tmp_path / "d.json"), "ordenes"]) == 0
        assert "1 códigos, 1 nombres" in capsys.readouterr().out
    finally:
        spark.sql("DROP DATABASE ordenes CASCADE")
    with pytest.raises(SystemExit):
        command.main([])
