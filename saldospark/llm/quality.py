"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

Random indexing: every word has a sparse random index vector (``NONZERO`` places of plus or minus one); a word's
vector is the sum of the index vectors of its neighbours over the whole corpus. Words are hashed into ``BUCKETS``
rows, so the table has a fixed size whatever the corpus: each task adds up its part, and the parts are summed by
row in a shuffle. A document is pooled as the mean of its words' vectors, the mean change between neighbouring
words (repetition changes little), and a few rates. A network with one hidden layer is trained in numpy on a
bounded sample of labelled rows; a temperature fitted on a part it hasn't seen calibrates its probabilities.

Words are runs of letters, of digits, or of one other sign; capitals beyond a word's first count as another word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, fold_of, segment_sum, text_slices, texts_of

BUCKETS, WIDTH, NONZERO = 1 << 14, 24, 4
SAMPLE_ROWS, HIDDEN = 12_000, 24
N_FEATURES = 2 * WIDTH + 6


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Of each code point: 1 lower-case or caseless letter, 2 upper-case letter, 3 digit, 4 sign, 0 white space."""
    table = np.full(0x110000, 4, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = 2 if c.isupper() else 1
        elif c.isdigit():
            table[cp] = 3
        elif c.isspace():
            table[cp] = 0
    return table


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    r = np.random.default_rng(7)
    places = np.argsort(r.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    return places, r.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every word, class of its first code point, offsets of documents) over all texts, in order."""
    cps, offsets = codepoints(texts)
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    kind = letter_table()[cps]
    group = np.where(kind == 2, 1, kind)
    start = np.ones(n, bool)
    start[1:] = group[1:] != group[:-1]
    sign = group == 4
    start[1:] |= sign[1:] & (cps[1:] != cps[:-1])
    start[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(start)
    # a polynomial hash of the run; a capital at its first place is folded, others are kept
    low = cps.astype(np.uint64)
    first = at[kind[at] == 2]
    low[first] |= np.uint64(0x20)
    place = (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))).astype(np.uint64)
    mixed = (low + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    sums = np.add.reduceat(mixed, at)
    sums ^= sums >> np.uint64(32)
    words = group[at] != 0
    at, bucket = at[words], (sums[words] % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, kind[at], np.searchsorted(at, offsets)


def neighbour_sums(bucket: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
    """Add to ``table`` (BUCKETS x WIDTH) the index vectors of both neighbours of each word."""
    if len(bucket) < 2:
        return
    places, signs = index_vectors()
    same = np.ones(len(bucket) - 1, bool)
    cut = offsets[1:-1]
    same[cut[(cut > 0) & (cut < len(bucket))] - 1] = False
    a, b = bucket[:-1][same], bucket[1:][same]
    pair, count = np.unique(a * BUCKETS + b, return_counts=True)
    a, b = pair // BUCKETS, pair % BUCKETS
    flat = table.reshape(-1)
    for x, y in ((a, b), (b, a)):
        for k in range(NONZERO):
            flat += np.bincount(x * WIDTH + places[y, k], weights=signs[y, k] * count, minlength=flat.size)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors over all documents, rows of length 1 (0 for unseen buckets)."""

    def count(batches):
        table = np.zeros((BUCKETS, WIDTH))
        for b in text_slices(batches, "text", 1 << 22):
            bucket, _, offsets = word_buckets(texts_of(b, "text"))
            neighbour_sums(bucket, offsets, table)
        used = np.flatnonzero(np.abs(table).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(table[used].astype(np.float32)), pa.list_(pa.float32()))], names=["bucket", "v"])

    parts = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, v array<float>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[i].cast("double")).alias(f"v{i}") for i in range(WIDTH)])
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    for r in sums.toLocalIterator():  # BUCKETS rows at most
        table[r[0]] = r[1:]
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pool(table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Features (documents x N_FEATURES)."""
    bucket, kind, offsets = word_buckets(texts)
    n = np.diff(offsets)[:, None]
    v = table[bucket]
    mean = segment_sum(v, offsets) / np.maximum(n, 1)
    change = np.zeros_like(v)
    same = np.zeros(len(bucket), np.float32)
    if len(bucket) > 1:
        change[1:] = np.abs(v[1:] - v[:-1])
        same[1:] = bucket[1:] == bucket[:-1]
        edge = offsets[:-1][offsets[:-1] < len(bucket)]
        change[edge], same[edge] = 0, 0
    step = segment_sum(change, offsets) / np.maximum(n - 1, 1)
    rates = [segment_sum(x.astype(np.float32), offsets) for x in (kind == 2, kind == 3, kind == 4, same)]
    chars = np.fromiter(map(len, texts), float, len(texts))[:, None]
    return np.hstack([mean, step, *(r[:, None] / np.maximum(n, 1) for r in rates), np.log1p(n), chars / np.maximum(n, 1) / 10]).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, steps: int = 1200, batch: int = 256, rate: float = 5e-3, decay: float = 1e-3, seed: int = 0) -> Network:
    """Adam on the cross-entropy; a fifth of the rows is set aside to fit the temperature."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    aside, learn = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x.mean(0), x.std(0) + 1e-3, r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    p = {"w1": net.w1, "b1": net.b1, "w2": net.w2, "b2": np.array([net.b2])}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    z = (x - net.mean) / net.scale
    for step in range(1, steps + 1):
        i = r.choice(learn, min(batch, len(learn)))
        h = np.tanh(z[i] @ p["w1"] + p["b1"])
        d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y[i]) / len(i)
        dh = np.outer(d, p["w2"]) * (1 - h * h)
        grad = {"w1": z[i].T @ dh + decay * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + decay * p["w2"], "b2": np.array([d.sum()])}
        for k, g in grad.items():
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.001 * (g * g - m2[k])
            p[k] -= rate * (1 - (step - 1) / steps) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"][0])
    if len(aside) and 0 < y[aside].mean() < 1:
        logit = net.logits(x[aside])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, np.where(y[aside] == 1, -logit, logit) / t)))

        net.temperature = min(np.geomspace(0.25, 8, 81), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (3, 1)) -> Network | None:
    """Train on about ``SAMPLE_ROWS`` labelled documents outside the held-out fold (by hash of the id); None without both labels."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", held_out[0]) != held_out[1])).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("doc_id")).groupBy("id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))  # one row for each id
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in text_slices(batches, "text"):
            x = pool(shipped.value, texts_of(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "y", "x"])

    found = rows.mapInArrow(run, "id string, y int, x array<float>").toPandas().sort_values("id", kind="stable")  # bounded
    if found["y"].nunique() < 2:
        return None
    return train(np.array(found["x"].tolist(), np.float64), found["y"].to_numpy(float))


def score(docs: DataFrame, table: np.ndarray, net: Network | None, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of ``docs``.

    Null and empty texts are scored as a document without words. Without a network every score is 0.5.
    ``held_out`` is null for a null id. Repeated rows each get their row; other columns are not read.
    """
    shipped, id_type = docs.sparkSession.sparkContext.broadcast((table, net)), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        table, net = shipped.value
        for b in text_slices(batches, "text"):
            p = net.probabilities(pool(table, texts_of(b, "text"))) if net else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    done = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")
    return done.select("doc_id", (fold_of("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
