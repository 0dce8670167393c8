"""What grows with the input: sorts, keys that many rows have in common, work repeated for each row."""

import re

import pytest
from pyspark.sql import functions as F

from saldospark.functions import plan
from saldospark.operators import classify as C
from saldospark.operators import feedback as H
from saldospark.plans.queries import QUERIES
from saldospark.sources import ordered
from saldospark.sources.tables import dictionary


def text(df, executed=False):
    q = df._jdf.queryExecution()
    return (q.executedPlan() if executed else q.optimizedPlan()).toString()


@pytest.fixture
def large_tables(spark, monkeypatch):
    """Every table counts as too large for a broadcast."""
    for module in (plan, H):
        monkeypatch.setattr(module, "small", lambda *_: False, raising=False)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def result(spark, n=4_000):
    """Rows of which one in ten has no code; names repeat."""
    i = F.col("id").cast("int")
    name = F.concat(F.lit("Cuenta  "), (i % 700).cast("string"))
    open_ = i % 10 == 3
    return plan.cut(spark.range(0, n, 1, 4).select(
        (i / 50).cast("int").alias("doc_id"), (i % 50).alias("linea"), name.alias("nombre_original"), F.when(open_, F.lit("")).otherwise(F.lit("AC.01")).alias("codigo_clasificado"),
        F.lit("m").alias("metodo"), F.when(open_, F.lit(0.0)).otherwise(F.lit(1.0)).alias("confianza"), open_.alias("requiere_revision")))


def same(a, b):
    return sorted(map(tuple, a.select(*b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def widest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_rows_that_ask_for_no_label_do_not_meet_in_one_task(spark, large_tables, monkeypatch):
    rows = result(spark)
    fixes = spark.createDataFrame([(f"cuenta {i}", "PC.08", i) for i in range(700)], "nombre_original string, codigo_nuevo string, seq int")
    large = [H.propagate_labels(rows), H.propagate_corrections(rows, fixes)]
    assert max(map(widest, large)) < 2_000  # 3,600 rows without a question
    monkeypatch.setattr(H, "small", lambda *_: True, raising=False)
    assert same(large[0], H.propagate_labels(rows)) and same(large[1], H.propagate_corrections(rows, fixes))


def accounts(spark):
    i = F.col("id").cast("int")
    names = F.element_at(F.array(*map(F.lit, ["Caja", "Arriendos", "Banco BCI Cta Cte", "Intereses y reajuste", "Bonos"])), i % 5 + 1)
    return spark.range(600).select(i.alias("doc_id"), F.lit(0).alias("linea"), F.when(i % 2 == 0, F.lit("1-01-01-01")).alias("codigo"), F.when(i % 11 > 0, F.concat(names, (i % 3).cast("string"))).alias("nombre"),
                                   F.when(i % 7 > 0, (i % 9 - 4).cast("double")).alias("monto"), F.element_at(F.array(*map(F.lit, ["activo", "pasivo", "ganancia"])), i % 3 + 1).alias("origen_columna"),
                                   F.lit(False).alias("es_total"), F.lit(1.0).alias("confianza_extraccion"), F.concat(F.lit("Comercio "), (i % 2).cast("string")).alias("giro"))


def test_accounts_with_many_names_are_not_sorted(spark, large_tables, monkeypatch):
    words = dictionary(spark, [("Caja 0", "AC.01", "manual")])
    many = C.classified(accounts(spark), words, "giro")
    assert re.search(r"ShuffledHashJoin \[[^\]]*nombre#\d+[^\n]*LeftOuter, BuildRight", text(many, executed=True))
    monkeypatch.setattr(C, "BROADCAST_ROWS", 200_000)
    assert same(many, C.classified(accounts(spark), words, "giro"))


def test_ambiguous_names_are_normalised_once(spark, sf_dir):
    assert text(QUERIES["classify_ambiguous"](spark, sf_dir)).count("regexp_replace(") == 3


def test_keywords_are_sought_once_for_a_name(spark):
    t = text(C.classified(accounts(spark), dictionary(spark, [("Caja 0", "AC.01", "manual")]), "giro"))
    above = t[: t.index("LeftOuter")]  # what is worked out for each row
    assert "Contains(nombre" not in above and "contains(nombre" not in above.lower()


def test_files_grow_with_the_detail(spark, sf_dir):
    assert ordered.files_for(spark.range(10)) == 8
    assert ordered.files_for(spark.range(4_500_001)) == 10


def test_detail_is_not_worked_out_again_for_the_ranges(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(ordered, "write_ordered", lambda df, path, *a, write=ordered.write_ordered: (seen.append(text(df)), write(df, path, *a)))
    assert QUERIES["detail_in_order"](spark, sf_dir).count() > 0
    assert seen[0].startswith("LogicalRDD")


def test_withdrawals_need_no_method(spark, sf_dir):
    assert "regla_especial" not in text(QUERIES["withdrawal_alerts"](spark, sf_dir))


def test_corrections_sort_no_rows(spark, large_tables):
    rows = result(spark)
    fixes = rows.where("codigo_clasificado = ''").select("doc_id", "linea", F.lit("PC.08").alias("codigo_nuevo"))
    got = H.apply_corrections(rows, fixes, "single")
    assert "SortMergeJoin" not in text(got, executed=True)
    assert sorted((r["codigo_clasificado"], r["count"]) for r in got.groupBy("codigo_clasificado").count().collect()) == [("AC.01", 3_600), ("PC.08", 400)]
