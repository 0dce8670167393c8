import math
import os
import re
import sys
from collections import Counter

import pytest
from docs import rows, written

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from against_sql import assert_same, connect

from saldospark.llm import lmscore, queries


def brute(data, order=2, backoff=0.4):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]

    def counts(w):
        c = Counter()
        for i in range(len(w)):
            for n in range(order):
                context = tuple(w[j] if j >= 0 else "\n" for j in range(i - n, i))
                c[n, context] += 1
                c[n, (*context, w[i])] += 1
        return c

    own = [counts(w) for w in docs]
    total = sum(own, Counter())
    out = []
    for (i, _), w, mine in zip(data, docs, own):
        s = 0.0
        for k in range(len(w)):
            below = None
            for n in range(order):
                context = tuple(w[j] if j >= 0 else "\n" for j in range(k - n, k))
                c, base = (total[n, g] - mine[n, g] for g in ((*context, w[k]), context))
                below = 1 / (base + 1) if below is None else below
                below = c / base if c else backoff * below
            s += math.log(below)
        out.append((i, len(w), round(s, 4)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(lmscore, "BATCH_BYTES", 50_000)
    monkeypatch.setattr(lmscore, "ROWS", 100)
    data = [(r[0], r[1]) for r in rows()]
    got = lmscore.score(written(spark, tmp_path / "d"), order=order).collect()
    want = brute(data, order)
    assert [(a, b) for a, b, _ in sorted(((r[0], r[1], 0) for r in got), key=str)] == sorted([(a, b) for a, b, _ in want], key=str)
    for g, w in zip(sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[1], round(r[2], 2))), sorted(want, key=lambda r: (str(r[0]), r[1], round(r[2], 2)))):
        assert g[2] == pytest.approx(w[2], abs=2e-3)


def test_empty(spark, tmp_path):
    assert lmscore.score(written(spark, tmp_path / "d", [])).count() == 0


def test_sql(spark, sf_dir):
    assert_same(queries.QUERIES["op8_lm_scoring"](spark, sf_dir), connect(sf_dir), queries.ORACLES["op8_lm_scoring"])


def test_slices_hot_contexts_and_shuffle_files(spark, tmp_path, monkeypatch):
    """The same scores whatever the slices and the contexts counted apart; the session's setting for shuffle files is as before."""
    docs = written(spark, tmp_path / "d")
    want = sorted(map(str, lmscore.score(docs).selectExpr("doc_id", "n_words", "round(log_score, 6)").collect()))
    for slices, hot, splits in ((1, 1, 64), (3, 50, 3), (5, 10**9, 1)):
        for name, value in (("SLICES", slices), ("HOT", hot), ("SPLITS", splits)):
            monkeypatch.setattr(lmscore, name, value)
        assert sorted(map(str, lmscore.score(docs).selectExpr("doc_id", "n_words", "round(log_score, 6)").collect())) == want
    assert spark.conf.get(lmscore.CLEANUP) == "false"
