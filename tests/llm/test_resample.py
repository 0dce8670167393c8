import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from saldospark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


def brute(docs, target):
    """The draw, document by document."""
    count = lambda texts: np.bincount([bucket(g) for t in texts for g in grams(t)[1]], minlength=10_000)
    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s.sum() + 10_000)) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(gain[bucket(g)] for g in found) // max(1, len(found))
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words)])
    eligible = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(eligible[: 25 * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, weight int, score int")


def test_resampling_equals_a_draw_by_hand(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "ÉTÉ", "日本", "a1b2", "X", "z" * 700, "y" * 128, "q" * 129]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " .,;\x00\x7f@[`{ "), (None, " ".join(words)), (7, docs[7][1]), (2000, "long " * 30_000), (2001, "a" * 300_000 + " b"), (2002, "x-y_z/0" * 9)] + [(3000 + i, "same words " * 12) for i in range(60)]
    target = ["w1 w2 w3 w1 w2", "Ñandú w5 été", None, ""]
    got = resample.resample(frame(spark, docs).repartition(7), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)
    assert sum(r[4] is not None for r in got.collect()) > 50


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "text string")
    assert resample.resample(frame(spark, []), empty).count() == 0
    docs = [(1, "uno dos"), (2, None)]
    assert sorted(map(tuple, resample.resample(frame(spark, docs), empty).collect()), key=str) == brute(docs, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ9 .é\x7f日"), max_size=300), max_size=6))
def test_features_of_a_buffer(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    got, row, words = resample.features(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [(i, bucket(g)) for i, t in enumerate(texts) for g in grams(t)[1]]
    assert sorted(zip(row.tolist(), got.tolist())) == sorted(want) and words.tolist() == [len(grams(t)[0]) for t in texts]
