"""Column-wise construction over a collection of aligned strings: Burrows-Wheeler transform and common prefixes.

The strings stand in a table, one per row, each from a column of its own on. Rounds go through the columns from the
last to the first: a round inserts one symbol per string, in front of what it already holds, and updates the order of
the strings by what they hold from this column on, the transform (the symbols in that order) and the common prefixes of
neighbours. Stable sorting of the symbols over the old order gives the new one; the common prefix of two new
neighbours with one symbol is one more than the least old common prefix between them, and 0 if the symbols differ.

Order and common prefixes stand in files. A round reads those of the round before from front to back, block by block, deals
each block out by symbol and writes it to new files; per symbol only the least common prefix since its last place is
kept. In memory are one block and one symbol of each string. The files are a task's own scratch (as a spill is): they have no
name, no other task reads them, and a task that runs again starts anew.

Since strings are aligned, equal windows stand in one column, so a column's order is all that has to be kept; the
number of rounds is the number of columns.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

BLOCK, SLICE = 1 << 18, 32
_FAR = np.iinfo(np.int32).max


def write_columns(strings: list[bytes], begin: np.ndarray, columns: int, out) -> None:
    """The symbols of every column, the last column first, ``SLICE`` columns at a time.

    Symbols are bytes plus one (byte 255 isn't part of UTF-8); 0 stands where a string has nothing.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    row = np.repeat(np.arange(m, dtype=np.int32), size)
    data = np.frombuffer(b"".join(strings), np.uint8)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size - begin, size)).astype(np.int32)
    for high in range(columns, 0, -SLICE):
        low = max(0, high - SLICE)
        here = (at >= low) & (at < high)
        table = np.zeros((high - low, m), np.uint8)
        table[high - 1 - at[here], row[here]] = data[here] + np.uint8(1)
        table.tofile(out)


class State:
    """Order and common prefixes of the strings, in files, with the places of each symbol's parts."""

    def __init__(self):
        self.files = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.size = 0

    def append(self, symbols: np.ndarray, order: np.ndarray, common: np.ndarray) -> None:
        """Add a block whose symbols are sorted."""
        order.astype(np.int32).tofile(self.files[0])
        common.astype(np.int32).tofile(self.files[1])
        cut = np.flatnonzero(np.diff(symbols, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(symbols)]):
            self.parts[int(symbols[a])].append((self.size + a, b - a))
        self.size += len(order)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(order, common prefixes) in order, in blocks."""
        spans: list[list[int]] = []
        for symbol in sorted(self.parts):
            for start, count in self.parts[symbol]:
                if spans and sum(spans[-1]) == start and spans[-1][1] + count <= BLOCK:
                    spans[-1][1] += count
                else:
                    spans.append([start, count])
        for start, count in spans:
            out = []
            for f in self.files:
                f.seek(4 * start)
                out.append(np.fromfile(f, np.int32, count))
            yield out[0], out[1]

    def close(self) -> None:
        for f in self.files:
            f.close()


def deal(symbols: np.ndarray, order: np.ndarray, common: np.ndarray, since: np.ndarray, state: State) -> None:
    """Insert one symbol per string of a block. ``since``: the least common prefix since each symbol's last place, -1 before the first."""
    symbols = symbols.astype(np.int64)
    new = np.argsort(symbols, kind="stable")
    s = symbols[new]
    lead = np.diff(s, prepend=-1) != 0
    least = np.zeros(len(new), np.int32)
    at = np.flatnonzero(~lead & (s > 0))  # the symbol stood in this block before
    if len(at):
        p, q = new[at - 1], new[at]
        count = q - p
        spans = np.repeat(p + 1 - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        least[at] = np.minimum.reduceat(common[spans], np.cumsum(count) - count) + 1
    first = np.flatnonzero(lead)
    known, before = s[first], since[s[first]]
    down = np.minimum.accumulate(common)[new[first]]
    least[first] = np.where((before >= 0) & (known > 0), np.minimum(before, down) + 1, 0)
    last = new[np.append(first[1:], len(s)) - 1]  # each symbol's last place in the block
    rest = np.append(np.minimum.accumulate(common[::-1])[::-1], _FAR)
    np.minimum(since, rest[0], out=since)
    since[known] = rest[last + 1]
    state.append(s, order[new], least)


def rounds(strings: list[bytes], begin: np.ndarray, columns: int):
    """Yields (column, order, transform, common prefixes) from the last column to the first, each column in blocks.

    String i stands in the columns from ``begin[i]`` on.
    """
    m = len(strings)
    with tempfile.TemporaryFile() as file:
        write_columns(strings, begin, columns, file)
        file.seek(0)
        state, symbols = State(), None
        for a in range(0, m, BLOCK):
            k = min(BLOCK, m - a)
            state.append(np.zeros(k, np.int64), np.arange(a, a + k), np.zeros(k))
        for column in range(columns - 1, -2, -1):
            new, since = State(), np.full(257, -1, np.int64)
            fresh = np.fromfile(file, np.uint8, m) if column >= 0 else None
            for order, common in state.blocks():
                if symbols is not None:
                    yield column + 1, order, symbols[order], common
                if fresh is not None:
                    deal(fresh[order], order, common, since, new)
            state.close()
            state, symbols = new, fresh
        state.close()


def window_groups(strings: list[bytes], begin: np.ndarray, width: int) -> np.ndarray:
    """For all windows of ``width`` bytes of all strings, string by string, a group: windows in one column have one group
    if, and only if, they are equal."""
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    windows = np.maximum(size - width + 1, 0)
    out = np.zeros(int(windows.sum()), np.int64)
    start = np.cumsum(windows) - windows - begin
    group, at = 0, None
    for column, order, _, common in rounds(strings, begin, int((begin + size).max(initial=0))):
        if column != at:
            group, at = column * (m + 1), column
        groups = group + np.cumsum(common < width)
        group = int(groups[-1])
        inside = (column >= begin[order]) & (column < begin[order] + windows[order])
        out[start[order[inside]] + column] = groups[inside]
    return out
