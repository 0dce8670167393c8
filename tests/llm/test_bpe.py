import base64
import hashlib

import pytest
import tiktoken
from docs import documents, rows, simple
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from saldospark.llm import bpe
from saldospark.llm.queries import VOCABULARY

DATA = open(VOCABULARY, "rb").read()
ENCODING = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})
MERGER = bpe.Merger(DATA)
PARTS = st.sampled_from(["'", "s", "t", "re", "ll", "'ve", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "?!", "　", " ", "\x1c", "́", "😀", "字", "D", " ", "٣", "ǅ"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=30).map("".join), max_size=5))
def test_equals_the_library(texts):
    assert [MERGER.encode(p) for p in bpe.split(texts)] == [ENCODING.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["&" * 3000, "ab" * 2000, "é" * 900, " " * 500, "x" * 65, "the" * 300])
def test_long_pieces(text):
    ids = MERGER.encode(bpe.split([text])[0])
    assert ids == ENCODING.encode_ordinary(text)
    assert MERGER.decode(ids).decode() == text


def test_digest(spark):
    got = sorted(map(tuple, bpe.bpe_digest(documents(spark), VOCABULARY).collect()), key=str)
    want = []
    for r in rows():
        ids = ENCODING.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.bpe_digest(documents(spark, []), VOCABULARY).count() == 0


def test_round_trip_and_offsets(spark):
    texts = ["héllo wörld's", None, "", "a  b"]
    tokens = bpe.encode(simple(spark, texts), VOCABULARY)
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode(tokens, VOCABULARY).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    for r in tokens.collect():
        data = (texts[r["doc_id"]] or "").encode()
        assert [data[a:b] for a, b in zip([0, *r["ends"]], r["ends"])] == [MERGER.words[i] for i in r["ids"]]


def test_small_cache():
    m, old = bpe.Merger(DATA), bpe.MAX_CACHE
    bpe.MAX_CACHE = 2
    try:
        pieces = [b"alpha", b"betax", b"gammay", b"alpha", b"deltaz", b"betax"] * 3
        assert m.encode(pieces) == [i for p in pieces for i in MERGER.merge(p)]
    finally:
        bpe.MAX_CACHE = old
