import random

import numpy as np
from docs import documents, simple, words

from saldospark.llm import decontaminate as D

R = random.Random(4)
ITEMS = [words(R, 12) for _ in range(6)]


def bench(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, doc_id long")


def distance(item, text):
    """Least edit distance of the item to a substring of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        now = np.empty_like(row)
        now[0] = i
        for j, d in enumerate(text, 1):
            now[j] = min(row[j - 1] + (c != d), row[j] + 1, now[j - 1] + 1)
        row = now
    return int(row.min())


def folded(text):
    chars, _ = D.normalize(D.codepoints([text])[0])
    return "".join(map(chr, chars)).strip()


def test_finds_exactly_what_the_edit_budget_allows(spark):
    texts = []
    for n in range(40):
        t = list(ITEMS[n % 6])
        for _ in range(R.randrange(14)):
            p, k = R.randrange(len(t)), R.random()
            t[p : p + 1] = [] if k < 0.3 else [R.choice("abcxyz")] if k < 0.7 else [t[p], "q"]
        texts.append(words(R, R.randrange(30)) + " -- " + "".join(t) + "! " + words(R, R.randrange(30)))
    got = {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(simple(spark, texts), bench(spark, ITEMS)).collect()}
    for d, text in enumerate(texts):
        for i, item in enumerate(ITEMS):
            budget, cost = int(len(folded(item)) * D.EDITS), distance(folded(item), folded(text))
            assert ((d, i) in got) == (cost <= budget), (d, i, cost, budget)
            if (d, i) in got:
                assert got[d, i]["edits"] == cost
                piece = folded(text[got[d, i]["start"] : got[d, i]["end"]])
                assert distance(folded(item), piece) == cost and abs(len(piece) - len(folded(item))) <= budget


def test_every_length_of_items():
    """Items of 1 to 60 characters against the edit distance, all texts in one slice."""
    r = random.Random(7)
    for m in range(1, 61):
        item = "".join(r.choice("abcdefghij") for _ in range(m))
        budget, texts = int(m * D.EDITS), [item[: m // 2], item[m // 2 :]]  # two halves side by side are no match
        for k in (0, budget, budget, budget + 1, budget + 1, budget + 2):
            t = list(item)
            for p in r.sample(range(m), min(k, m)):
                t[p] = r.choice(("", "y", t[p] + "y"))
            texts.append("z" * r.randrange(9) + "".join(t) + "z" * r.randrange(9))
        found = {(d, c) for d, ids, s, e, c in D.matches(D.build([(1, item)]), texts)}
        best = {d: min(c for x, c in found if x == d) for d, _ in found}
        assert best == {d: c for d, t in enumerate(texts) if (c := distance(item, t)) <= budget}, m


def test_spans_case_and_borders(spark):
    text = "Ab.\n" + ITEMS[0].upper().replace(" ", ",\t") + "\x01" + ITEMS[1]
    got = sorted((r["item_id"], text[r["start"] : r["end"]]) for r in D.find_leaks(simple(spark, [text, ITEMS[2][:40], ITEMS[2][40:]]), bench(spark, ITEMS)).collect())
    assert got == [(0, ITEMS[0].upper().replace(" ", ",\t")), (1, ITEMS[1])]


def test_edge_cases(spark):
    odd = bench(spark, [None, "", "short", ITEMS[0], ITEMS[0], "x" * 300, "?!", "漢"])
    docs = documents(spark)
    hits = D.find_leaks(docs, odd).collect()
    assert {(r["item_id"], r["doc_id"]) for r in hits} == {(5, 11), (5, 15), (7, 3)}
    assert D.find_leaks(documents(spark, []), odd).count() == 0
    assert D.find_leaks(docs, bench(spark, [])).count() == 0
    assert sorted(r["item_id"] for r in D.find_leaks(simple(spark, ["a " + ITEMS[0]]), odd).collect()) == [3, 4]


def test_drop_leaks_keeps_the_rest(spark):
    docs = documents(spark)
    kept = D.drop_leaks(docs, bench(spark, ["x" * 300]))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] not in (11, 15))


def test_blocks(spark):
    old, D.BLOCK_CHARS = D.BLOCK_CHARS, 100
    try:
        got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(simple(spark, ITEMS), bench(spark, ITEMS)).collect()}
        assert got == {(i, i) for i in range(6)}
        assert D.drop_leaks(simple(spark, [*ITEMS, "clean"]), bench(spark, [*ITEMS, "clean"])).count() == 1
    finally:
        D.BLOCK_CHARS = old
