"""Byte-level BPE: pre-tokenisation over code-point classes, cached pair merging, decoding by offsets.

Pre-tokenisation uses no regex. Each code point gets a class (letter, number, white space, other). The machine
that cuts the text has two sorts of transition functions: constant ones (the class changes or a document
begins: a new run starts here) and the identity (the run goes on). Such functions compose associatively, "the
last constant wins", so one running maximum gives every position the start of its run; what is left (the
blank that joins the next run, contractions) depends on the run's start and two neighbours.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, text_slices, texts_of

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points with the property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
MAX_CACHE = 200_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[list(WHITE)] = SPACE
    return table


def boundaries(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a pre-token starts; ``offsets`` (with the end last) says where documents begin."""
    n = len(cps)
    if n == 0:
        return np.zeros(0, dtype=bool)
    cls = classes()[cps]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True  # a document's first place; the end counts too
    reset = begins[:n].copy()
    reset[1:] |= cls[1:] != cls[:-1]
    run = np.maximum.accumulate(np.where(reset, np.arange(n), 0))  # the scan: last constant function wins
    start = run == np.arange(n)

    space = cls == SPACE
    before = np.zeros(n, dtype=bool)  # white space right before a run of another class, in the same document
    before[:-1] = space[:-1] & ~space[1:] & ~begins[1:n]
    start |= before
    after = np.flatnonzero(before & (cps == 0x20)) + 1  # a blank joins what follows
    start[after] = False

    quote = np.flatnonzero((cps == 0x27) & start)
    if len(quote):
        end = np.append(offsets[1:], n)[np.searchsorted(offsets[1:], quote, side="right")]
        at = lambda k: np.where(quote + k < end, cps[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, width in ((one, 2), (two, 3)):
            q = quote[hit]
            start[q + 1] = False
            stop = q + width
            start[stop[stop < end[hit]]] = True
    return start


class Merger:
    """Pair merging by rank for one pre-token at a time, with a bounded cache."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.words = {i: w for w, i in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}  # the generation before: what is still used moves on

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        if n <= 64:
            get, none = ranks.get, 1 << 60
            parts = [piece[i : i + 1] for i in range(n)]
            pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
            while pairs and (least := min(pairs)) < none:
                at = pairs.index(least)
                parts[at] += parts.pop(at + 1)
                del pairs[at]
                if at < len(pairs):
                    pairs[at] = get(parts[at] + parts[at + 1], none)
                if at:
                    pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            return tuple([ranks[p] for p in parts])
        # long pieces: a heap of pairs over a linked list, n log n
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := left[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, pieces: list[bytes]) -> list[int]:
        out: list[int] = []
        cache, add = self.cache, out.extend
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = self.older.get(p) or self.merge(p)
                if len(cache) >= MAX_CACHE:
                    self.older, self.cache = cache, {}
                    cache = self.cache
                if len(p) <= 64:
                    cache[p] = ids
            add(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offsets where each token ends."""
        return np.cumsum([len(self.words[i]) for i in ids], dtype=np.int64).tolist()


def split(texts: list[str]) -> list[list[bytes]]:
    """The pre-tokens of each text, as UTF-8 slices."""
    cps, offsets = codepoints(texts)
    start = boundaries(cps, offsets)
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    place = np.concatenate(([0], np.cumsum(width)))
    data = "".join(texts).encode("utf-8", "surrogatepass")
    at = np.flatnonzero(start)
    first = np.searchsorted(at, offsets)
    cuts = place[at].tolist() + [len(data)]
    return [[data[a:b] for a, b in zip(cuts[i:j], cuts[i + 1 : j + 1])] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]


_MERGERS: dict[str, Merger] = {}


def merger(vocabulary: bytes) -> Merger:
    """One per worker process, so that the cache outlives a task."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[key] = Merger(vocabulary)
    return _MERGERS[key]


def _ship(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about a megabyte


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, ends array<int>): token ids and the byte offsets where tokens end. Null text counts as empty."""
    shipped, id_type = _ship(docs, vocabulary), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = merger(shipped.value)
        for b in text_slices(batches, "text"):
            ids = [m.encode(p) for p in split(texts_of(b, "text"))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([m.offsets(x) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids", "ends"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>, ends array<int>")


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary) from token ids; null ids count as none. An id outside the vocabulary is an error."""
    shipped, id_type = _ship(tokens, vocabulary), tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        m = merger(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {id_type}, data binary")


def bpe_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same encoding and its decoding, without shipping ids between stages.

    A row for each row of ``docs``; null and empty texts have no token and the hashes of nothing.
    """
    shipped, id_type = _ship(docs, vocabulary), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = merger(shipped.value)
        names = {i: str(i) for i in m.words}
        for b in text_slices(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for pieces in split(texts_of(b, "text")):
                ids = m.encode(pieces)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(m.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
