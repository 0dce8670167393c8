import json
import random

import pytest
from pyspark.sql import functions as F

from saldospark.sources import jsonarray, merge, tables


def everything(spark, table, *columns):
    return sorted(tuple(r) for r in spark.table(table).select(*columns).collect())


def files_of(spark, table):
    return {r[0] for r in spark.table(table).select("_metadata.file_path").distinct().collect()}


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE mezcla LOCATION '{tmp_path / 'db'}'")
    yield "mezcla"
    spark.sql("DROP DATABASE mezcla CASCADE")


def test_merge_touches_only_its_buckets(spark, database):
    table = f"{database}.t"
    merge.create(spark, table, "k string, v int")
    merge.merge(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, v int"), table, "k")
    before = files_of(spark, table)
    new = [("k1", -1), ("k2", -2), ("zz", -3), (None, 9)]
    for _ in range(2):  # a repeated load changes nothing
        merge.merge(spark.createDataFrame(new, "k string, v int"), table, "k")
        want = {f"k{i}": i for i in range(200)} | dict(new)
        assert {r["k"]: r["v"] for r in spark.table(table).collect()} == want and spark.table(table).count() == len(want)
    touched = {r[0] for r in spark.createDataFrame(new, "k string, v int").select(merge.bucket_of("k")).collect()}
    same = {f for f in before if int(f.split(f"{merge.BUCKET}=")[1].split("/")[0]) not in touched}
    assert same and same <= files_of(spark, table) and len(before - files_of(spark, table)) == len(before - same)


@pytest.mark.parametrize("step", ["pending", "replace", "drop"])
def test_a_load_that_dies_loses_nothing(spark, database, monkeypatch, step):
    table = f"{database}.t"
    merge.create(spark, table, "k string, v int")
    merge.merge(spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int"), table, "k")
    new = spark.createDataFrame([("k1", -1), ("n", 5)], "k string, v int")

    def dies(s, t, pending):
        if step == "pending":  # nothing was replaced yet, and the pending table isn't known
            s.sql(f"DROP TABLE {pending}")
        elif step == "replace":  # the buckets were emptied, their new files not put in
            for (b,) in s.table(pending).select(merge.BUCKET).distinct().collect():
                s.sql(f"ALTER TABLE {t} DROP PARTITION ({merge.BUCKET} = {b})")
        else:
            merge.overwrite_buckets(s.table(pending).select(*s.table(t).columns), t)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(merge, "_replace", dies)
        with pytest.raises(RuntimeError):
            merge.merge(new, table, "k")
    assert merge.recover(spark, table) == (step != "pending")
    merge.merge(new, table, "k")
    assert everything(spark, table, "k", "v") == sorted([(f"k{i}", -1 if i == 1 else i) for i in range(100)] + [("n", 5)])
    assert not merge.recover(spark, table)


def test_a_refused_connection_raises(spark):
    def read(message):
        def f():
            raise OSError(message)
        return f

    with pytest.raises(OSError):
        tables.read_or_empty(read("Connection refused"))
    assert tables.read_or_empty(read("No suitable driver found for jdbc:x")).count() == 0


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_partitioned_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'derby'};create=true"
    rows = [(i * i if i else None, f"n{i}") for i in range(200)]
    spark.createDataFrame(rows, "ID long, NAME string").write.jdbc(url, "cuentas", properties=DERBY)
    for more in ({}, {"column": "ID", "partitions": 4}, {"column": "ID", "partitions": 4, "hashed": True}):
        df = tables.read_jdbc(spark, url, "cuentas", DERBY, **more)
        assert sorted(map(tuple, df.toDF("id", "name").collect()), key=str) == sorted(rows, key=str)
        assert df.rdd.getNumPartitions() == (4 if more else 1)
        plan = df.where(F.col(df.columns[0]) == 49)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo" in plan.split("PushedFilters:")[1].split("]")[0]
    sizes = tables.read_jdbc(spark, url, "cuentas", DERBY, column="ID", partitions=4, hashed=True).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 101  # squares are 0 or 1 modulo 4
    empty = tables.read_jdbc(spark, url, "(SELECT * FROM cuentas WHERE ID < 0) v", DERBY, column="ID", partitions=4)
    assert empty.count() == 0


def elements(seed, n):
    rng = random.Random(seed)
    odd = ['a}b', '{"x":[1', 'q"uote', "back\\", "]", "[{", "ñ—", "", "\n", "}}", '\\"}', ",", "x" * 300]
    word = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(4)))
    return [{"cuenta_original": word(), "codigo_estandar": rng.choice([None, word()]), "fuente": word(), "otros": {word(): [{word(): rng.random()}, []]}} for _ in range(n)]


@pytest.mark.parametrize("split, indent", [("1m", 2), ("333b", None), ("97b", None)])
def test_array_elements_at_every_split(spark, tmp_path, split, indent):
    files = {"a": elements(1, 30), "b": elements(2, 7), "c": [], "d": [{}], "e": [{"cuenta_original": "solo"}]}
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, ensure_ascii=name == "a", indent=indent))
    (tmp_path / "f.json").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = jsonarray.array_elements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, data in files.items():
        mine = sorted((r["lugar"], r["texto"]) for r in got if r["archivo"].endswith(f"{name}.json"))
        assert [i for i, _ in mine] == list(range(len(data))) and [json.loads(t) for _, t in mine] == data
    assert not any(r["archivo"].endswith("f.json") for r in got)


def test_lookup_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_lookup(spark.range(200_000).select((F.col("id") * 2).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), path, "k", files=4, row_group_bytes=1 << 18)
    table, wanted = spark.read.parquet(path), spark.createDataFrame([(10,), (10,), (11,), (None,), (399_998,)], "k long")
    found = tables.lookup_many(table, wanted, "k")
    assert sorted(r["k"] for r in found.collect()) == [10, 399_998]

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    assert scanned(found) < 0.2 * scanned(table) and scanned(tables.lookup_many(table, wanted.where("k = 11"), "k")) == 0  # 11 lies within a range, the filter has it not
    many = spark.range(0, 5_000).select(F.col("id").alias("k"))
    assert tables.lookup_many(table, many, "k").count() == 2_500
    assert tables.lookup_many(table, wanted.where("k is null"), "k").count() == 0
