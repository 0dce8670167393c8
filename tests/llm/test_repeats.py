import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from docs import rows, written, words

from saldospark.llm import batches, columns, repeats


def brute(data):
    """(id, bytes, removed, spans, hash) with a set of all windows, documents by id (null last), then in the given order."""
    seen, out = set(), []
    for i, text in sorted(data, key=lambda x: (x[0] is None, x[0] or 0)):
        x = (text or "").encode()
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 99):
            w = x[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((i, len(x), len(x) - len(kept), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    passages = [words(r, n) for n in (15, 30, 60)] + ["é" * 70, "ab" * 120]
    texts = [" ".join(r.choice([words(r, r.randrange(1, 25)), r.choice(passages)]) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    return list(enumerate(r.sample(texts, 60))) + [(100 + i, t) for i, t in enumerate(texts[:10])]


@pytest.mark.parametrize("hot, batch_bytes", [(5000, 2 << 20), (2, 3000), (5000, 1500), (0, 1 << 20), (3, 1500)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, hot, batch_bytes):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4000)
    data = corpus()
    docs = written(spark, tmp_path / "d", [(i, t, *rows()[0][2:]) for i, t in data])
    got = sorted((tuple(r)[:5] for r in repeats.removals(docs, hot=hot, batch_bytes=batch_bytes).collect()), key=str)
    assert got == brute(data)


def test_edge_cases(spark, tmp_path):
    docs = written(spark, tmp_path / "d")
    data = [(r[0], r[1]) for r in rows()]
    got = repeats.removals(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(data)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert repeats.removals(written(spark, tmp_path / "e", [])).count() == 0


def test_anchors_depend_on_content_only():
    r = random.Random(3)
    passage = words(r, 40).encode()
    a, b = (r.randbytes(n) + passage + r.randbytes(50) for n in (211, 407))
    for text, shift in ((a, 211), (b, 407)):
        first, last, h, *_ = repeats.anchors(text)
        inside = {(int(f) - shift, int(x)) for f, e, x in zip(first, last, h) if f >= shift and e + 100 <= shift + len(passage)}
        if shift == 211:
            kept = inside
    assert kept and len(kept & inside) >= len(kept) - 2


@pytest.mark.parametrize("block", [1, 3, 1 << 18])
def test_column_wise_construction(monkeypatch, block):
    """Order, transform, common prefixes and window groups of every column against plain sorting, in blocks of several sizes."""
    monkeypatch.setattr(columns, "BLOCK", block)
    monkeypatch.setattr(columns, "SLICE", 2 if block < 9 else 32)
    r = random.Random(1)
    for _ in range(60):
        strings = ["".join(r.choice("ab") for _ in range(r.randrange(10))).encode() for _ in range(r.randrange(1, 12))]
        begin = np.array([r.randrange(4) for _ in strings])
        width = int((begin + [len(s) for s in strings]).max())
        padded = [[0] * b + [c + 1 for c in s] + [0] * (width - b - len(s)) for s, b in zip(strings, begin)]
        found = {}
        for column, *block_ in columns.rounds(strings, begin, width):
            assert len(block_[0]) <= max(block, 1)
            found.setdefault(column, []).append(block_)
        assert list(found) == list(range(width - 1, -1, -1))
        for column, parts in found.items():
            order, transform, common = (np.concatenate(x) for x in zip(*parts))
            rest = [p[column:] for p in padded]
            assert order.tolist() == sorted(range(len(strings)), key=lambda i: rest[i])
            assert transform.tolist() == [rest[i][0] for i in order]
            shared = [next((n for n, (x, y) in enumerate(zip(rest[i], rest[j])) if x != y or not x), width - column) for i, j in zip(order, order[1:])]
            assert common.tolist() == [0, *shared]
        groups, want, place = columns.window_groups(strings, begin, 3), {}, 0
        for s, b in zip(strings, begin):
            for k in range(len(s) - 2):
                want.setdefault((int(b) + k, s[k : k + 3]), set()).add(int(groups[place]))
                place += 1
        assert place == len(groups) and all(len(g) == 1 for g in want.values()) and len({next(iter(g)) for g in want.values()}) == len(want)


def test_hash_of_spans():
    data = np.frombuffer(b"abcabc", np.uint8)
    h = batches.span_hash(batches.prefix_hash(data), np.array([0, 3]), np.array([3, 6]))
    assert h[0] == h[1]


def test_anchors_in_steps(monkeypatch):
    """A text that is looked at in steps has the anchors of the whole one."""
    text = words(random.Random(4), 900).encode()
    whole = repeats.anchors(text)
    monkeypatch.setattr(repeats, "STEP", 333)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(text)))


def test_repeated_ids_go_by_place(spark, tmp_path):
    """Documents of one id are in the order of their partitions and rows, also beyond ten batches."""
    passage = words(random.Random(7), 40)
    data = [(5, passage + f" {i:03d}") for i in range(40)]
    (tmp_path / "d").mkdir()
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in data]), "text": [t for _, t in data]}), tmp_path / "d" / "a.parquet")
    got = repeats.removals(spark.read.parquet(str(tmp_path / "d")), batch_bytes=600, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(data)
    assert [bytes(r["kept"]).decode() for r in got if r["n_removed"] == 0] == [data[0][1]]


