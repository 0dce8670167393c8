import random

import pytest

from saldospark.operators import feedback as H
from saldospark.streaming import ingest, propagate

COLUMNS = [c.split()[0] for c in propagate.ROW.split(", ")]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, propagate.PROVIDER)
    yield
    spark.conf.set(key, old)


def ledger_rows(seed):
    rng = random.Random(seed)
    names = ["Caja", "caja  ", "Banco X", "Otros", None, "", "Puente"]
    return [(f"d{rng.randrange(6)}", i, rng.choice(names + ["Caja"] * 5), rng.choice(["", "", "AC.01", "PC.02", "__EXCLUIR__"]), "m", 0.5, True) for i in range(80)]


@pytest.mark.parametrize("seed, batches", [(1, 1), (3, 5)])
def test_any_split_ends_like_the_whole(spark, tmp_path, rocks, seed, batches):
    rows = ledger_rows(seed)
    want = sorted(map(tuple, H.propagate_labels(spark.createDataFrame(rows, propagate.ROW)).select(*COLUMNS).collect()), key=str)
    random.Random(seed).shuffle(rows)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(propagate.ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k in range(batches):  # the query is started anew for each part, from its checkpoint
        spark.createDataFrame(rows[k::batches], propagate.ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k % 2 == 0 or k == batches - 1:
            for q in propagate.run(stream, str(tmp_path / "out"), str(tmp_path / "ck"), salts=3):
                q.awaitTermination()
    assert sorted(map(tuple, propagate.latest(spark, str(tmp_path / "out")).select(*COLUMNS).collect()), key=str) == want


def test_provider_is_asked_for(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="RocksDB"):
        propagate.run(spark.readStream.schema(propagate.ROW).parquet(str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c"))


def test_a_new_checkpoint_beside_old_output_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("1-01-01 Caja 500\n")
    go = lambda ck: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / ck)).awaitTermination()
    go("a"), go("a")
    with pytest.raises(ValueError, match="another checkpoint"):
        go("b")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
