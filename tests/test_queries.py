import pytest
from against_sql import assert_same, connect

from saldospark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["balance_by_code"](spark, sf_dir).count() > 0


def test_category_totals_equal_code_totals(spark, sf_dir):
    total = {r["nivel"]: 0.0 for r in QUERIES["balance_rollup_category"](spark, sf_dir).select("nivel").distinct().collect()}
    for r in QUERIES["balance_rollup_category"](spark, sf_dir).collect():
        total[r["nivel"]] += r["monto_total"]
    assert total[0] == pytest.approx(total[1]) == pytest.approx(total[3])
