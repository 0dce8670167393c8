import numpy as np
import pytest

from saldospark.llm import cells, whitening

VECTORS = "vec_id long, embedding array<float>, label int, h string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y") for i, v in rows], VECTORS)


def brute(rows, threshold=0.9):
    """Links and components by comparing every pair of rows."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    width = max((len(v) for _, v in good), default=0)
    u = np.array([np.pad(v, (0, width - len(v))) / np.linalg.norm(v) for _, v in good]).reshape(len(good), width)
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    label = np.array([i for i, _ in good], dtype=np.int64)
    while True:
        after = np.array([min([label[k], *label[hit[k]]]) for k in range(len(good))], dtype=np.int64)
        if (after == label).all():
            break
        label = after
    out = [(i, int(n), int(c), i == c) for (i, _), n, c in zip(good, hit.sum(1), label)]
    rest = [(i, 0, i, i is not None) for i, v in rows if not (i is not None and v and None not in v and np.isfinite(v).all() and np.any(v))]
    return sorted(out + rest, key=str)


def near(x, cosine, rng):
    z = rng.normal(size=len(x))
    z -= (z @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def planted(seed, singles, groups, dim=64):
    """Random directions, and groups of copies at given cosines from one of them."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(singles, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    more = [near(u[k], c, rng) * s for k, (size, c, s) in enumerate(groups) for _ in range(size)]
    all_ = np.vstack([u, *([more] if more else [])])
    return [(int(i), all_[k].tolist()) for k, i in enumerate(rng.permutation(len(all_)))]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("cell, block", [(32, 16), (64, 2048), (10_000, 64)])
def test_near_duplicates_equal_all_pairs(spark, cell, block):
    rows = planted(3, 300, [(120, 0.99, 1), (20, 0.93, 3.0), (8, 0.905, 1e-3), *[(2, 0.97, 1)] * 20])
    rows += [(10_000 + i, rows[5][1]) for i in range(40)] + [(rows[7][0], rows[7][1])]  # equal vectors, a repeated row
    assert found(cells.near_duplicates(table(spark, rows).repartition(5), cell=cell, block=block, reach=0.2237)) == brute(rows)


def test_recall_at_the_default_reach(spark):
    rng = np.random.default_rng(11)
    rows = planted(5, 3000, [(1, c, 1) for c in rng.uniform(0.9005, 0.99, 1200)])
    got = cells.near_duplicates(table(spark, rows), cell=32).select("n_links").toPandas()["n_links"].sum()
    want = sum(r[1] for r in brute(rows))
    assert 0.98 * want <= got <= want


def test_vectors_without_links(spark):
    rows = [(1, None), (2, []), (3, [0, 0]), (4, [None, 1]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (None, [1, 0]), (7, [1e30, 0]), (8, [2e-30]), (9, [0, 1]), (9, [0, 2]), (9, [1, 1]), (12, [-0.0, 5])]
    assert found(cells.near_duplicates(table(spark, rows))) == brute(rows)
    assert found(cells.near_duplicates(table(spark, rows[:6]))) == brute(rows[:6])
    assert found(cells.near_duplicates(table(spark, []))) == []


def test_centres_stay_apart():
    rng = np.random.default_rng(0)
    tight = rng.normal(size=(400, 16)) * 0.02 + np.eye(16)[0]
    wide = rng.normal(size=(200, 16))
    c = cells.spherical_kmeans(cells.unit(np.vstack((tight, wide))), 40)
    between = c @ c.T - np.eye(len(c))
    assert len(c) > 20 and between.max() <= cells.MERGE and np.allclose(np.linalg.norm(c, axis=1), 1)


def white_by_covariance(rows, components=4):
    """Eigenvectors of the covariance of the distinct rows, which the operator itself never forms."""
    good = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    width = max((len(v) for _, v in good), default=0)
    x = np.array([np.pad(np.floor(np.array(v, np.float32).astype(float) * 256), (0, width - len(v))) for _, v in good]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True).reshape(width, width)
    e, vec = np.linalg.eigh(v)
    e, vec = e[::-1][:components], vec[:, ::-1][:, :components]
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(1), (x - s / n) @ vec / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_the_covariance_way(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 12)) @ np.diag([4, 3, 2, 1.5, *[0.3] * 8]) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(600 + i, base[3].tolist()) for i in range(300)] + [(3, base[3].tolist()), (None, base[4].tolist()), (1000, base[5][:7].tolist()), (1001, []), (1002, None), (1003, [None] * 12), (1004, [float("nan")] * 12)]
    ids, n, deviation, white, explained = white_by_covariance(rows)
    got = whitening.whiten(table(spark, rows).repartition(11)).toPandas()
    assert sorted(got.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    assert len(got) == 4 * len(ids) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    order = np.lexsort((white[:, 0], deviation, [-1 if i is None else i for i in ids]))
    for k in range(4):
        part = got[got["component"] == k + 1]
        sign = np.sign((part.groupby("deviation")["whitened"].first() * [white[deviation == d, k][0] for d in sorted(set(deviation))]).sum())
        mine = sorted(zip(part["vec_id"].fillna(-1), part["deviation"], part["whitened"]))
        want = sorted((-1 if i is None else i, d, w * sign) for i, d, w in zip(ids, deviation, white[:, k]))
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert np.allclose([m[2] for m in mine], [w[2] for w in want], atol=1e-9) and np.allclose(part["explained"], explained[k], rtol=1e-9)
    assert len(order) == len(ids)


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0  # no variance
    line = whitening.whiten(table(spark, [(1, [1, 2, 0]), (2, [2, 4, 0]), (3, [4, 8, 0])])).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1) and np.isclose((line["whitened"] ** 2).mean(), 1)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e30]), (2, [-1e30])])).count()


def test_fold_is_associative():
    a = np.random.default_rng(1).normal(size=(90, 6))
    one, two = whitening.fold(None, a), whitening.fold(whitening.fold(None, a[:40]), whitening.fold(None, a[40:]))
    assert np.allclose(one.T @ one, two.T @ two)
