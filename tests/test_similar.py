import itertools
import random

import pytest

from saldospark.functions import text as T
from saldospark.operators import similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def all_pairs(left, right, least):
    return sorted((a, b) for a in left for b in right if a and b and 200 * lcs(a, b) >= least * (len(a) + len(b)))


WORDS = "caja banco clientes proveedor cuentas por cobrar pagar impuesto renta activo fijo leasing obra terreno ventas costo gasto socio".split()


def near(name, rng):
    """The name with up to three characters taken out, put in or changed."""
    s = list(name)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(s) + 1)
        if rng.random() < 0.5 and i < len(s):
            del s[i]
        else:
            s.insert(i, rng.choice("abcñz09 "))
    return "".join(s)


@pytest.mark.parametrize("least", [67.0, 75.0, 90.0, 100.0])
def test_pairs_equal_a_search_over_all(spark, least):
    rng = random.Random(int(least))
    left = sorted({" ".join(rng.sample(WORDS, rng.randrange(1, 4))) for _ in range(40)} | {"a", "b", "ab", "ba", "", "aa", "aaa", "aaaa", "ñ", "日本"})
    right = sorted({near(x, rng) for x in left} | set(left))
    a, b = (spark.createDataFrame([(x,) for x in v] + [(None,)], f"{c} string") for v, c in ((left, "a"), (right, "b")))
    got = similar.similar_pairs(a, b, "a", "b", least).collect()
    assert sorted((r["a"], r["b"]) for r in got) == all_pairs(left, right, least)
    assert all(r["puntaje"] == pytest.approx(200 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"]))) for r in got)


def test_candidates_stay_far_below_the_product(spark):
    rng = random.Random(9)
    names = sorted({" ".join(sorted(rng.sample(WORDS, 2) + [f"{rng.choice(WORDS)[:4]}{rng.choice(WORDS)[-3:]}", "".join(rng.choices("abcdefghilmnoprstu", k=7))])) for _ in range(2_100)})[:2_000]
    assert len(names) == 2_000
    df = spark.createDataFrame([(n,) for n in names], "a string").repartition(4)
    met = similar.candidates(df, df.withColumnRenamed("a", "b"), "a", "b", 90.0).count()
    assert 2_000 <= met < 0.01 * 2_000**2
    keys = similar.indexed(df, "a", 90.0, "_l").groupBy("key").count().agg({"count": "sum"}).first()[0]
    assert keys < 100 * 2_000


def test_below_the_least_score_is_refused(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError):
        similar.candidates(df, df, "a", "a", 50.0)


def test_order_is_one_for_all_strings(spark):
    df = spark.createDataFrame([("banana",), ("abanan",)], "a string")
    assert len({tuple(r["c"]) for r in df.select(similar._ordered(T.token_sort(df.a)).alias("c")).collect()}) == 1
    for (x, y) in itertools.combinations(["", "a", "ab"], 2):
        assert lcs(x, y) == min(len(x), len(y))
