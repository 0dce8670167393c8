"""Target-distribution importance resampling with hashed word n-grams.

Features are single words and pairs of consecutive words; each falls into one of ``BUCKETS`` by its CRC-32. The log ratio of
target to corpus frequency is a bucket's gain; a document weighs the mean gain of its features. Gumbel noise, a function of
the document's id, turns weights into a draw without replacement: the documents with the highest scores.

Words and checksums come from whole slices of the Arrow text buffer at once:

* A lookup table classifies every byte, and differences of the classes are word boundaries. Letters, digits and all bytes
  from 0x80 on are word bytes; the first byte of a row's text is never joined to the row before.
* Every word is cut into pieces of at most ``PIECE`` bytes. All pieces advance their CRC by one byte in each step, through the
  byte table; shorter ones fall out. A CRC is linear, so the state after a concatenation is the state of the left part advanced
  over as many zero bytes as the right part has, xor the right part's. Tables for 2 ** k zero bytes join pieces to words and words to pairs,
  so a word of any length takes few steps.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices

BUCKETS = 10_000
PIECE = 128
MIN_WORDS = 20
PERCENT = 25
SEED = 7
_U32 = np.uint32


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each byte, and whether it is a byte of a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        word[a:b] = True
    return lower, word


LOWER, WORD = _byte_tables()


@functools.cache
def _step() -> np.ndarray:
    """The state after one byte, for the reflected polynomial of CRC-32."""
    t = np.arange(256, dtype=_U32)
    for _ in range(8):
        t = np.where(t & _U32(1), (t >> _U32(1)) ^ _U32(0xEDB88320), t >> _U32(1))
    return t


def _through(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A linear map of the state, given as one table for each of its bytes."""
    return tables[0][state & _U32(255)] ^ tables[1][(state >> _U32(8)) & _U32(255)] ^ tables[2][(state >> _U32(16)) & _U32(255)] ^ tables[3][state >> _U32(24)]


@functools.cache
def _zeros(k: int) -> np.ndarray:
    """The map of 2 ** k zero bytes."""
    if k == 0:
        basis = (np.arange(256, dtype=_U32)[None, :] << (_U32(8) * np.arange(4, dtype=_U32))[:, None]).astype(_U32)
        return _step()[basis & _U32(255)] ^ (basis >> _U32(8))
    half = _zeros(k - 1)
    return _through(half, _through(half, (np.arange(256, dtype=_U32)[None, :] << (_U32(8) * np.arange(4, dtype=_U32))[:, None]).astype(_U32)))


def advance(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """States after ``length`` zero bytes."""
    state = state.astype(_U32, copy=True)
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        if len(at):
            state[at] = _through(_zeros(k), state[at])
    return state


def pieces_crc(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Linear states (from zero) of the spans, all advanced together; a span has ``PIECE`` bytes at most."""
    order = np.argsort(-length, kind="stable")
    at, state = start[order], np.zeros(len(start), _U32)
    alive = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
    table = _step()
    for j, n in enumerate(alive):
        s = state[:n]
        state[:n] = table[(s ^ data[at[:n] + j]) & _U32(255)] ^ (s >> _U32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def words_crc(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Linear states of words of any length, joined from pieces."""
    count = -(-length // PIECE)
    first = np.concatenate(([0], np.cumsum(count)))
    nth = np.arange(first[-1]) - np.repeat(first[:-1], count)
    size = np.minimum(PIECE, np.repeat(length, count) - nth * PIECE)
    piece = pieces_crc(data, np.repeat(start, count) + nth * PIECE, size)
    state = piece[first[:-1]]
    for j in range(1, int(count.max(initial=1))):
        more = np.flatnonzero(count > j)
        k = first[more] + j
        state[more] = advance(state[more], size[k]) ^ piece[k]
    return state


def features(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, words of each row) of all features of the rows ``buffer[offsets[i]:offsets[i + 1]]``."""
    data, rows = LOWER[buffer], len(offsets) - 1
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = WORD[buffer]
    edge = np.diff(inside)
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word that ends a row beside one that begins the next
    start = np.sort(np.concatenate((np.flatnonzero(edge == 1), cuts)))
    length = np.sort(np.concatenate((np.flatnonzero(edge == -1), cuts))) - start
    row = np.searchsorted(offsets, start, side="right") - 1
    single = words_crc(data, start, length)
    pair = np.flatnonzero(row[1:] == row[:-1])
    left = single[pair]
    left = _step()[(left ^ _U32(32)) & _U32(255)] ^ (left >> _U32(8))
    double = advance(left, length[pair + 1]) ^ single[pair + 1]
    state = np.concatenate((single, double))
    size = np.concatenate((length, length[pair] + 1 + length[pair + 1]))
    crc = ~(state ^ advance(np.full(len(state), 0xFFFFFFFF, _U32), size))
    return (crc % _U32(BUCKETS)).astype(np.int64), np.concatenate((row, row[pair])), np.bincount(row, minlength=rows)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in text_slices(batches, "text"):
        text = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
        text = pa.array([t or b"" for t in text.to_pylist()], pa.large_binary()) if text.null_count else text
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        body = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        yield b, body, ends - ends[0]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Features in each bucket over all rows; a partition sends one row for each bucket it holds, and the driver gets ``BUCKETS`` rows at most."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, body, ends in _slices(batches):
            total += np.bincount(features(body, ends)[0], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(target: dict[int, int], corpus: dict[int, int]) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) for each bucket."""
    t_all, s_all = sum(target.values()), sum(corpus.values())
    return np.array([
        math.floor(1000 * math.log(((target.get(b, 0) + 1) * (s_all + BUCKETS)) / ((corpus.get(b, 0) + 1) * (t_all + BUCKETS)))) for b in range(BUCKETS)
    ], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b, body, ends in _slices(batches):
            bucket, row, words = features(body, ends)
            n = np.bincount(row, minlength=len(words))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, row, gain[bucket])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """``weights`` with ``score``: the weight plus Gumbel noise (in thousandths), which the id and the seed fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, share: int, eligible, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``rank``: places 1, 2, ... by falling score and rising id for the best ``share`` percent of the eligible rows, else null.

    Scores are whole thousandths whose noise differs between documents, so a score holds under 0.04 % of the rows in expectation. Rows
    are placed within their score; the score's first place follows from counts per score, of which there are some ten thousands
    however many rows there are. ``rows`` is read more than once and should be cheap.
    """
    counts = rows.where(eligible).groupBy(score).agg(F.count("*").alias("here"))
    above = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = counts.withColumn("upto", F.sum("here").over(above)).withColumn("all", F.sum("here").over(Window.partitionBy()))
    first = first.select(F.col(score).alias("_score"), (F.col("upto") - F.col("here")).alias("_before"), F.floor(F.col("all") * share / 100).alias("_drawn"))
    first = first.where("_before < _drawn")
    within = F.row_number().over(Window.partitionBy(score, "_in").orderBy(id_col))
    joined = rows.withColumn("_in", F.coalesce(eligible, F.lit(False))).join(first, F.col("_in") & (F.col(score) == F.col("_score")), "left")
    drawn = joined.where(F.col("_score").isNotNull()).withColumn("rank", (F.col("_before") + within).cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    rest = joined.where(F.col("_score").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_in", "_score", "_before", "_drawn")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``.

    Null and empty texts have no feature and weigh 0. A row with a null id keeps its weight, has a null score and isn't drawn. Rows
    that repeat an id are rows of their own with the same noise; in a tie their order is open, the set of ranks is not.
    An empty corpus gives no row, an empty target a uniform one. Columns besides id and text are left out.
    """
    gain = gains(bucket_counts(target, target_text), bucket_counts(docs, text_col))
    rows = materialize(scored(weigh(docs, gain, id_col, text_col), seed))
    out = ranked(rows, share, (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    return out.select("doc_id", "n_features", "weight", "score", "rank")
