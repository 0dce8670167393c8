"""Benchmark decontamination: q-gram counting in diagonal bands, then banded alignment.

A benchmark item of m characters that stands in a document with at most e edits keeps m - q + 1 - q * e of its
q-grams there (q-gram lemma), and all of them lie on diagonals (place in the text minus place in the item) that
span at most e. So hits are counted per item in bands of 2(e + 1) diagonals that overlap by half; a region that
reaches the bound is aligned with the item inside its band, and kept if the edit distance is at most e.

The edit budget is ``EDITS`` of an item's length, rounded down. ``Q`` characters make a gram; for short items, whose bound
would fall below 1 at that budget, fewer do: m // (e + 1), so that even an item of one character is found.

Texts are compared in lower case, as letters and digits with single blanks between words; a match is reported
in code points of the original text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, materialize, text_slices

Q = 10
EDITS = 0.08
#: The benchmark is taken in blocks of about so many characters, each shipped to the tasks on its own.
BLOCK_CHARS = 4_000_000
BREAK = 1  # stands between documents, and matches nothing


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower case of letters and digits; 0 for any other code point."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def normalize(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single blanks, and the place in ``cps`` of each."""
    low = np.where(cps == BREAK, BREAK, fold_table()[cps])
    gap = low == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return np.where(gap, 0x20, low)[at], at


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram at every place (1 <= q <= 16)."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    small = np.zeros(len(chars) + 8, np.uint8)
    small[: len(chars)] = (chars ^ (chars >> 7) ^ (chars >> 11)).astype(np.uint8)
    eight = np.empty(len(chars), np.uint64)
    for o in range(8):
        part = small[o : o + (len(small) - o) // 8 * 8].view(np.uint64)
        eight[o::8] = part[: len(eight[o::8])]
    if q < 8:
        return (eight[:n] << np.uint64(64 - 8 * q)) * np.uint64(0x9E3779B97F4A7C15)
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(1))


@dataclass
class Index:
    """Distinct items of a block that have one length of grams, with their q-grams in sorted order."""

    q: int
    ids: list[list]  # the ids of each distinct item
    items: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # occurrences of gram g: first[g] .. first[g + 1]
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    shift: int


def build(rows: list[tuple], q: int = Q, rate: float = EDITS, min_chars: int = 1) -> list[Index]:
    """An index for each length of grams over ``rows``: (id, text). Items of fewer than ``min_chars`` characters after folding are left out."""
    by_text: dict[bytes, tuple[np.ndarray, list]] = {}
    for key, text in rows:
        chars, _ = normalize(codepoints([text or ""])[0])
        if len(chars) and chars[0] == 0x20:
            chars = chars[1:]
        if len(chars) and chars[-1] == 0x20:
            chars = chars[:-1]
        if len(chars) >= max(1, min_chars):
            by_text.setdefault(chars.tobytes(), (chars, []))[1].append(key)
    by_q: dict[int, list[tuple[np.ndarray, list, int]]] = {}
    for chars, ids in by_text.values():
        e = int(len(chars) * rate)
        by_q.setdefault(min(q, len(chars) // (e + 1)), []).append((chars, ids, e))
    return [_index(g, *map(list, zip(*by_q[g]))) for g in sorted(by_q)]


def _index(q: int, items: list[np.ndarray], ids: list[list], edits: list[int]) -> Index:
    m, e = np.array([len(c) for c in items], np.int64), np.array(edits, np.int64)
    keys = [grams(c, q) for c in items]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    found, first = np.unique(flat[order], return_index=True)
    shift = 64 - min(26, max(16, int(math.log2(len(found) + 1)) + 5))
    table = np.zeros(1 << (64 - shift), bool)
    table[(found >> np.uint64(shift)).astype(np.int64)] = True
    item, place = np.repeat(np.arange(len(items)), [len(k) for k in keys])[order], np.concatenate([np.arange(len(k)) for k in keys])[order]
    return Index(q, ids, items, e, m - q + 1 - q * e, found, np.append(first, len(flat)), item, place, table, shift)


def banded(item: np.ndarray, text: np.ndarray, starts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start s: the least edit distance of ``item`` to a substring of ``text`` on diagonals s .. s + band - 1,
    and the end (exclusive) of the first such substring. All candidates move through the rows together."""
    width = np.arange(band)
    at = starts[:, None] + width
    cost = np.zeros((len(starts), band), np.int32)  # row 0: a match may begin anywhere in the band
    for i, c in enumerate(item):
        place = at + i
        same = text[np.clip(place, 0, len(text) - 1)] == c
        same &= (place >= 0) & (place < len(text))
        step = cost + ~same
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the item is missing
        cost = np.minimum.accumulate(step - width, axis=1) + width  # extra characters of the text
    best = cost.argmin(axis=1)
    return cost[np.arange(len(starts)), best], starts + best + len(item)


def matches(indexes: list[Index], texts: list[str]) -> list[tuple[int, list, int, int, int]]:
    """(text, ids of the item, start, end, edits) of every region of every text, in code points of the text.

    Between texts stand more breaks than any item has edits, so no region reaches from one into the next.
    """
    if not indexes:
        return []
    gap = 1 + max(int(i.edits.max()) for i in indexes)
    lens = np.array([len(t) + gap for t in texts], np.int64)
    cps, _ = codepoints([t + "\x01" * gap for t in texts])
    begins = np.concatenate(([0], np.cumsum(lens)))
    # the break itself may stand in a text: then it is an ordinary gap
    inner = (cps == BREAK) & (np.arange(len(cps)) < np.repeat(begins[1:] - gap, lens))
    if inner.any():
        cps = np.where(inner, 0x20, cps)
    chars, origin = normalize(cps)
    out = []
    for index in indexes:
        for k, s, t, c in regions(index, chars):
            while chars[s] == BREAK:
                s += 1
            t = min(t, len(chars))
            while chars[t - 1] == BREAK:
                t -= 1
            a, b = int(origin[s]), int(origin[t - 1]) + 1
            d = int(np.searchsorted(begins, a, side="right")) - 1
            out.append((d, index.ids[k], a - int(begins[d]), b - int(begins[d]), c))
    return out


def regions(index: Index, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of every region, in places of ``chars``."""
    key = grams(chars, index.q)
    hit = np.flatnonzero(index.filter[(key >> np.uint64(index.shift)).astype(np.int64)])
    g = np.searchsorted(index.grams, key[hit])
    g[g == len(index.grams)] = 0
    good = index.grams[g] == key[hit]
    hit, g = hit[good], g[good]
    if not len(hit):
        return []
    times = index.first[g + 1] - index.first[g]
    total = int(times.sum())
    occ = np.repeat(index.first[g], times) + np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    item, diagonal = index.item[occ], np.repeat(hit, times) - index.place[occ]
    step = index.edits[item] + 1
    cell = (diagonal + (1 << 20)) // step  # places in a slice stay far below 2 ** 40
    code = np.concatenate([(item << 42) + cell, (item << 42) + cell - 1])
    code, count = np.unique(code, return_counts=True)
    who = code >> 42
    enough = count >= index.bound[who]
    who, cell = who[enough], (code & ((1 << 42) - 1))[enough]
    found = []
    for k in np.unique(who):
        e, chars_k = int(index.edits[k]), index.items[k]
        m, lo = len(chars_k), cell[who == k] * (e + 1) - (1 << 20)
        cost, end = banded(chars_k, chars, lo, 2 * (e + 1))
        ok = cost <= e
        cost, end, lo = cost[ok], end[ok], lo[ok]
        if not len(cost):
            continue
        # where the match begins: the same alignment from its end, both reversed
        back = len(chars) - end
        _, tail = banded(chars_k[::-1], chars[::-1], back - e, 2 * e + 1) if e else (None, back + m)
        start = len(chars) - tail
        taken = -1
        for j in np.lexsort((cost, end)):  # overlapping regions of one item count once, the least distance wins
            s, t = max(0, int(start[j])), int(end[j])
            if s < taken:
                if cost[j] < found[-1][-1]:
                    found[-1] = (int(k), s, t, int(cost[j]))
                    taken = max(taken, t)
                continue
            found.append((int(k), s, t, int(cost[j])))
            taken = t
    return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of a bounded number of characters (by hash of the row), one after the other."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    dealt = materialize(dealt) if n > 1 else dealt
    for i in range(n):
        yield sorted(((r["id"], r["text"]) for r in dealt.where(F.col("block") == i).collect()), key=lambda r: (r[1], str(r[0])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): a row for each place where a benchmark item stands in a document.

    The edit budget is ``EDITS`` of the item's length. Null and empty texts have no match; null items and items without a
    letter or digit are left out. Items that repeat a text are all named. Repeated documents each get
    their rows. Other columns are not read.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    arrow = pa.int64() if item_type in ("bigint", "int", "smallint", "tinyint") else pa.string()
    picked, out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), None
    for rows in blocks(benchmark, item_id, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(rows)  # BLOCK_CHARS bounds it

        def run(batches, shipped=shipped):
            index = build(shipped.value)
            for b in text_slices(batches, "text"):
                hits = [(d, i, s, e, c) for d, ids, s, e, c in matches(index, [t or "" for t in b.column(1).to_pylist()]) for i in ids]
                d, i, s, e, c = zip(*hits) if hits else ((),) * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d, pa.int64())), pa.array([x if x is None or arrow == pa.int64() else str(x) for x in i], arrow), *(pa.array(x, pa.int64()) for x in (s, e, c))], names=["doc_id", "item_id", "start", "end", "edits"])

        part = picked.mapInArrow(run, f"doc_id {id_type}, item_id {'long' if arrow == pa.int64() else 'string'}, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item stands, of whatever length; one pass for each block of the benchmark, no shuffle."""
    for rows in blocks(benchmark, item_id, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shipped=shipped):
            index = build(shipped.value)
            for b in text_slices(batches, text_col):
                bad = {d for d, *_ in matches(index, [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
