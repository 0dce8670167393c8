"""Batches of documents: runs of rows of one scan partition, for operators that combine before they shuffle.

A batch's key is a hash of its place (partition, and number there), its ids and its texts. What an operator finds for a
batch goes back to it by this key. The input is planned twice, so it must be a stable relation (files or a
checkpoint); where the two plans see different batches, the join fails loudly instead of giving wrong rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

BATCH_BYTES = 8 << 20
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, modulo 2 ** 64; see ``span_hash``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def batches(source: Iterator[pa.RecordBatch], max_bytes: int = BATCH_BYTES) -> Iterator[tuple[int, int, pa.Array, list[bytes]]]:
    """(key, place, ids, texts as UTF-8) of the batches of a partition; column 0 is the id, column "text" binary.

    Places are numbers in the order of the partitions and of the batches in them; keys are hashes of place, ids and texts.
    """
    part = TaskContext.get().partitionId()
    for k, b in enumerate(text_slices(source, "text", max_bytes)):
        place = part << 32 | k
        texts = [t or b"" for t in b.column(1).to_pylist()]
        seal = xxhash.xxh3_64(f"{place} {b.column(0).to_pylist()}".encode())
        for t in texts:
            seal.update(len(t).to_bytes(8, "little"))
            seal.update(t)
        yield int.from_bytes(seal.digest(), "big", signed=True), place, b.column(0), texts


def text_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def whole_batches(docs: DataFrame, id_col: str, text_col: str, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, place, ids, texts): a row for each batch."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(source):
        for key, place, ids, texts in batches(source, max_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([place]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([texts], pa.list_(pa.binary()))], names=["batch", "place", "ids", "texts"])

    return text_bytes(docs, id_col, text_col).mapInArrow(run, f"batch long, place long, ids array<{id_type}>, texts array<binary>")
