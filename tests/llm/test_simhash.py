import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from docs import documents, rows, simple, words

from saldospark.llm import common, simhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_edge_cases_equal_brute_force(spark):
    got = sorted(map(tuple, simhash.near_duplicates(documents(spark)).collect()), key=str)
    ids, prints = [r[0] for r in rows()], [fingerprint(r[1]) for r in rows()]
    want = [(i, p - (1 << 64) if p >= 1 << 63 else p, c) for i, p, c in zip(ids, prints, components(ids, prints))]
    assert got == sorted(want, key=str)


def linked(spark, prints):
    """The groups of fingerprints that ``links`` joins."""
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    label = {r["node"]: r["label"] for r in common.connected_components(edges).collect()}
    return partition([label.get(s, s) for s in signed])


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, []).append(i)
    return {tuple(g) for g in groups.values()}


def test_links_give_the_components(spark):
    """Chains and clouds of fingerprints at distances 1 to 4."""
    r = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        p = r.getrandbits(64)
        for _ in range(25):
            p ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3, 4])))
            prints.add(p)
    prints = sorted(prints)
    assert linked(spark, prints) == partition(components(list(range(len(prints))), prints))


def test_crowded_cells(spark):
    """3,000 fingerprints around one centre, up to five bits away: most share every cell with thousands."""
    r = random.Random(2)
    centre, prints = r.getrandbits(64), set()
    while len(prints) < 3000:
        prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([2, 3, 4, 5]))))
    prints = sorted(prints)
    assert linked(spark, prints) == partition(components(list(range(len(prints))), prints))


def test_popcounts_and_fine_cells(spark):
    r = random.Random(3)
    prints = [0, -1, 1 << 62, -(1 << 63), *(r.getrandbits(64) - (1 << 63) for _ in range(20))]
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    unpack = lambda x: [x >> 2 * s & 3 for s in range(32)]
    pc = simhash.popcounts(table.fp)
    for row in table.select("fp", pc.alias("pc"), simhash.fine_cells(pc, table.fp).alias("cells")).collect():
        counts = [bin(row["fp"] >> 2 * s & 3).count("1") for s in range(32)]
        assert unpack(row["pc"]) == counts
        near = {tuple(counts)} | {tuple(counts[:s] + [counts[s] + d] + counts[s + 1 :]) for s in range(32) for d in (-1, 1) if 0 <= counts[s] + d <= 2}
        assert sorted(tuple(unpack(c["cell"])) for c in row["cells"]) == sorted(near)
        places = [p for c in row["cells"] for p in c["places"]]
        assert len(places) == len(set(places)) == 65 and all(bin((p ^ row["fp"]) & (1 << 64) - 1).count("1") <= 1 for p in places)
        for c in row["cells"]:
            for p in c["places"]:
                assert [bin(p >> 2 * s & 3).count("1") for s in range(32)] == unpack(c["cell"])


def test_one_cell_of_five_thousand_points(spark):
    """Fingerprints with one bit in every segment: one cell, distances 2, 4, ... within it; few of the pairs are links."""
    r, prints = random.Random(8), set()
    while len(prints) < 5000:
        p = sum(1 << 2 * s + r.randrange(2) for s in range(32))
        prints.add(p)
        for _ in range(r.randrange(3)):
            p ^= 3 << 2 * r.randrange(32)
            prints.add(p)
    prints = sorted(prints)
    table = spark.createDataFrame([(p,) for p in ((q - (1 << 64)) if q >= 1 << 63 else q for q in prints)], "fp long")
    assert table.select(simhash.popcounts(table.fp)).distinct().count() == 1
    assert linked(spark, prints) == partition(components(list(range(len(prints))), prints))


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def similar_groups(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_keep_one_finds_near_copies(spark):
    """Copies with a few edits, each from one of several originals, among other texts and a common passage."""
    r = random.Random(6)
    common_part = words(r, 30)
    texts = [words(r, n) for n in (60, 90, 150, 300) for _ in range(4)] + [words(r, 20) + " " + common_part for _ in range(10)] + ["four words are here", "four words are here", "", None, "Four  words\nare here"]
    for t in texts[:16]:
        for _ in range(4):
            w = t.split()
            for _ in range(r.randrange(1, 1 + len(w) // 50)):
                w[r.randrange(len(w))] = r.choice(["edit", "other words", "x"])
            texts.append(" ".join(w))
    groups = similar_groups(texts)
    left = {row["doc_id"] for row in simhash.keep_one(simple(spark, texts)).collect()}
    assert left == set(groups) and len(left) < len(texts) - 50


def edited(r, text, edits):
    w = text.split()
    for i in r.sample(range(len(w)), edits):
        w[i] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_keep_one_finds_an_original_in_the_middle(spark):
    """Copies that are similar to the original only, which has neither the smallest nor the largest id."""
    r = random.Random(3)
    original = " ".join(f"w{r.randrange(10**6)}" for _ in range(300))
    texts = [original if i == 20 else edited(r, original, 6) for i in range(40)] + ["another text that stands alone here"]
    assert set(similar_groups(texts)) == {0, 40}
    assert {row["doc_id"] for row in simhash.keep_one(simple(spark, texts)).collect()} == {0, 40}


@pytest.mark.parametrize("frequent", [0, 1 << 18])
def test_keep_one_equals_brute_force(spark, monkeypatch, frequent):
    """Copies of copies around the limit of the similarity, short and long, with a passage that is common to many."""
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    r = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = []
    for size in (1, 4, 5, 6, 9, 14, 40, 120):
        for _ in range(3):
            chain = [" ".join(f"w{r.randrange(10**6)}" for _ in range(size)) + (" " + passage if size > 9 else "")]
            for _ in range(8):
                chain.append(edited(r, r.choice(chain), r.randrange(1, 2 + size // 40)))
            texts += chain
    r.shuffle(texts)
    assert {row["doc_id"] for row in simhash.keep_one(simple(spark, texts)).collect()} == set(similar_groups(texts))


def test_fingerprint_links_stay(spark, monkeypatch):
    """Of a chain of links the middle one is proposed too, and a document with an equal fingerprint by its first."""
    prints = spark.createDataFrame([(10, 0), (11, 3), (12, 15), (13, 15), (14, 255 << 40)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    assert {tuple(r) for r in simhash.fingerprint_pairs(simple(spark, ["x"]), "doc_id", "text").collect()} == {(10, 11), (11, 12), (12, 13)}


def test_keep_one(spark):
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    data = {r[0]: r[1] for r in rows() if r[0] is not None}
    groups = similar_groups([data[i] for i in sorted(data)])
    want = [(i, data[i]) for i in sorted(set(groups))] + [(None, "only here, without an id")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_prefixes_meet(spark):
    """Sets at the limit of the similarity have as many prefix shingles in common as the docstring says, in any common order."""
    r = np.random.default_rng(5)
    for n in (*range(1, 60), 100, 333, 1000):
        for m in {n, -(-4 * n // 5), 5 * n // 4, max(1, n - 1)}:
            common_n = -(-4 * (n + m) // 9)
            if common_n > min(n, m):
                continue
            for lean in (0, 1, 2):  # what differs stands first, anywhere, or last
                both, one, two = np.split(np.sort(r.permutation(10**6)[: n + m - common_n]) if lean == 1 else np.arange(n + m - common_n), [common_n, n])
                if lean == 0:
                    both, one, two = both + 10**6, one, two
                a, b = (simhash.prefix_of(np.sort(np.concatenate((both, x))).astype(np.uint64), np.zeros(0, np.uint64), np.zeros(0)) for x in (one, two))
                assert len(np.intersect1d(a, b)) >= 1 + min(n, m) // 20 >= 1 + n // 25


@pytest.mark.parametrize("group", [1, 64])
def test_common_shingle_in_many_documents(spark, monkeypatch, group):
    """A cluster in which most are too far from each other, compared as rows and in small blocks."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "BLOCK_DOCS", 7)
    monkeypatch.setattr(simhash, "PART", 3)
    r = random.Random(8)
    original = " ".join(f"w{r.randrange(10**6)}" for _ in range(120))
    chain = [original]
    for _ in range(60):
        chain.append(edited(r, r.choice(chain), r.randrange(1, 5)))
    r.shuffle(chain)
    want = set(similar_groups(chain))
    assert 1 < len(want) < 50
    assert {row["doc_id"] for row in simhash.keep_one(simple(spark, chain)).collect()} == want


def test_block_links_equal_all_pairs():
    r = np.random.default_rng(6)
    base = np.arange(400, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(400) > 0.08], r.integers(10**6, 10**9, r.integers(0, 30)).astype(np.uint64)))) for _ in range(60)]
    label = [int(x) for x in r.integers(0, 40, 60)]
    for block in (np.zeros(60, int), np.arange(60) % 2):
        pairs = [(i, j) for i, j in itertools.combinations(range(60), 2) if (block[i] != block[j] or not block.any()) and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
        found = simhash.block_links(sets, label, block)
        assert set(found) <= set(pairs) and len(found) < 60

        def joined(links):
            at = {x: x for x in label}
            for i, j in links:
                a, b = at[label[i]], at[label[j]]
                at = {k: a if v == b else v for k, v in at.items()}
            return partition([at[x] for x in label])

        assert joined(found) == joined(pairs)


def test_empty_and_single(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0
    assert [tuple(r)[2] for r in simhash.near_duplicates(simple(spark, ["one text"], 5)).collect()] == [5]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(400, 401), (401, 400), (500, 500)], "a long, b long")
    got = {r["node"]: r["label"] for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {400: 400, 401: 400}


def test_common_passage_proposes_no_pairs(spark):
    """A passage in 3,000 documents that share nothing else: none of its shingles is kept, and all documents stay."""
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"d{i}w{k}" for k in range(60)) + " " + passage for i in range(3000)] + [passage, passage + " end"]
    docs = simple(spark, texts)
    assert simhash.rare_shared(docs, "doc_id", "text").where("doc_id < 3000").count() == 0
    assert {row["doc_id"] for row in simhash.keep_one(docs).collect()} == set(range(3001))
