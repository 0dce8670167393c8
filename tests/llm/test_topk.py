import math
import os
import random
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from against_sql import assert_same, connect

from saldospark.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, n long, qb long, w string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "w") for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, w) in enumerate(fine):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v)), i) for at, (i, v) in enumerate(fine) if at != own)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_equals_brute_force(spark, block):
    r = random.Random(2)
    f = lambda: [r.randrange(-8, 8) / 8 for _ in range(5)]  # noqa: E731  exact in float, many ties
    rows = [(i, f()) for i in range(0, 400, 5)] + [(7, None), (8, [1.0, None, 0.0, 0.0, 0.0]), (9, [float("nan")] * 5), (11, [float("inf")] * 5), (200, f()), (200, f()), *[(300, [0.5] * 5)] * 3, *[(305, [4.0] * 5)] * 14, *[(310, [3.5] * 5)] * 2, (13, []), (None, f()), (15, [0.0] * 5), (-100, f())]
    got = sorted(tuple(x) for x in topk.top_k(frame(spark, rows), block=block).collect())
    assert got == sorted(brute(rows))


def test_scores_that_are_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        topk.top_k(frame(spark, [(100, [1e12] * 3), (1, [1e12] * 3)])).collect()


def test_small_tables(spark):
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(100, [1.0])])).count() == 0
    assert [tuple(x) for x in topk.top_k(frame(spark, [(100, [1.0]), (1, [0.5])])).collect()] == [(100, 1, 1, 1024 * 512)]


def test_sql(spark, sf_dir):
    assert_same(queries.QUERIES["op3_exact_top_k"](spark, sf_dir), connect(sf_dir), queries.ORACLES["op3_exact_top_k"])
    assert duckdb.__version__
