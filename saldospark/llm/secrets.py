"""Secret scan: three base patterns, and a guess-cost model for other credential-context values.

The model is a dynamic program over a value: the cheapest way to cut it into ranked words, dates, repeats,
keyboard walks and brute-force spans, cost being log10 of the guesses an attacker needs. A value that stands
after a credential word and costs at least ``min_cost`` is a secret; a cheap one (a plain word, a date) isn't.
Words and their ranks come from the entries of a public tokenizer's vocabulary: an entry's rank is its place
among the letter-only entries, so frequent words cost little.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts_of

KINDS = ("assign", "access", "hex", "guess")
# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_WORDS = (
    r"(?ai:password|passphrase|passcode|passwd|pass|pwd|pin|secret|token|bearer|credentials?|auth|login|"
    r"api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?secret)"
)
#: A credential word is no part of a longer word, but may stand in a joined name: DB_PASS, aws_secret_access_key.
_NAME = rf"(?<![A-Za-z0-9]){_WORDS}(?:[_-][A-Za-z0-9]{{1,32}}){{0,3}}"
_VALUE = r"""["']?([^\s"']{6,})"""
#: What a value can stand behind: a name with a separator (the value on the same line or the next) or "is"; an option of a command
#: line; a scheme of an authorization header; a user in an address.
CONTEXTS = (
    re.compile(rf"""{_NAME}["']?(?:\x20*(?:=>|:=|[:=])\x20*(?:\r?\n[\x20\t]*)?|\x20+is\x20+){_VALUE}"""),
    re.compile(rf"(?<![^\s\"'])--(?:[A-Za-z0-9]{{1,32}}-){{0,3}}{_WORDS}(?:-[A-Za-z0-9]{{1,32}}){{0,3}}\x20+{_VALUE}"),
    re.compile(rf"""(?<![A-Za-z0-9])(?ai:authorization)["']?\x20*[:=]\x20*["']?(?ai:bearer|basic|token|digest|apikey)\x20+{_VALUE}"""),
    re.compile(r"""://[^\s/:@"']{0,256}:([^\s/@"']{6,})@"""),
)
MIN_COST = 10.0

_HEX_RUN = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
# The rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_SEP = "[-/._]?"
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", "(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Dates by shape; at one place a shape matches in one way at most. A year alone has fewer values than a day.
_DATES = [(re.compile(f"(?=({p}))", re.ASCII), math.log10(n)) for p, n in [
    (_YEAR, 120), (_YEAR + _SEP + _MONTH + _SEP + _DAY, 120 * 365),
    *((day + _SEP + _MONTH + _SEP + year, 120 * 365) for day in (_DAY, "[1-9]") for year in (_YEAR, r"\d\d")),
]]
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_ranks(vocabulary: bytes) -> dict[str, float]:
    """log10 of the rank of each entry of three or more ASCII letters, lower case, of a file of base64 entries in rank order."""
    ranks: dict[str, float] = {}
    for line in vocabulary.splitlines():
        word = base64.b64decode(line.split()[0]).strip().lower()
        if len(word) >= 3 and word.isalpha():
            ranks.setdefault(word.decode("ascii"), math.log10(len(ranks) + 2))
    return ranks


def word_finder(ranks: dict[str, float]) -> ahocorasick.Automaton:
    """Finds all ranked words in one pass."""
    finder = ahocorasick.Automaton()
    for word, rank in ranks.items():
        finder.add_word(word, (len(word), rank))
    if len(finder):
        finder.make_automaton()
    return finder


def _class_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.islower() else 26 if c.isupper() else 33)


def _run_ends(true: np.ndarray) -> np.ndarray:
    """For each place the first place from there on that is not true."""
    stops = np.where(true, len(true), np.arange(len(true)))
    return np.minimum.accumulate(stops[::-1])[::-1]


class _Starts:
    """Where segments of one kind began, to find the cheapest for each end when the cost is g(start) + log10(end - start).

    An earlier start gains on a later one as the end moves on. So a start that is no better than a later one is never needed
    again, nor is a later one that an earlier one has overtaken; few are left at any time.
    """

    def __init__(self, least: int):
        self.least, self.waiting, self.held = least, deque(), []

    def add(self, start: int, g: float) -> None:
        self.waiting.append((start, g))

    def best(self, end: int) -> float:
        """The least g(start) + log10(end - start) over starts at least ``least`` before the end."""
        held = self.held
        while self.waiting and end - self.waiting[0][0] >= self.least:
            start, g = self.waiting.popleft()
            while held and held[-1][1] >= g:
                held.pop()
            held.append((start, g))
        low, kept = math.inf, 0
        for start, g in held:
            value = g + math.log10(end - start)
            if value < low:  # later starts that cost more now always will
                low = value
                held[kept] = (start, g)
                kept += 1
        del held[kept:]
        return low


def _repeats(cps: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By start: (end, start, width) of the longest runs of a repeated unit of one to four characters that isn't itself a repeat."""
    found, n, ends_of = {}, len(cps), {}
    for width in range(1, min(4, n // 2) + 1):
        same = cps[width:] == cps[:-width]
        ends = _run_ends(same)
        ends_of[width] = ends
        first = np.flatnonzero(same & ~np.concatenate(([False], same[:-1])))
        for i in first[ends[first] - first >= width].tolist():
            if not any(width % shorter == 0 and ends_of[shorter][i] - i >= width - shorter for shorter in range(1, width)):
                found.setdefault(i, []).append((int(ends[i]) + width, i, width))
    return found


def _walks(plain: str) -> tuple[list[int], list[int]]:
    """For each character where the walk over neighbouring keys that goes through it ends, and the number of turns up to there."""
    n = len(plain)
    row, col = np.full(128, -9), np.zeros(128, np.int64)
    for c, (r, k) in _PLACE.items():
        row[ord(c)], col[ord(c)] = r, k
    keys = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    keys = np.where(keys < 128, keys, 0)
    down, right = np.diff(row[keys]), np.diff(col[keys])
    on = (row[keys[1:]] >= 0) & (row[keys[:-1]] >= 0) & (abs(down) <= 1) & (abs(right) <= 1) & ((down != 0) | (right != 0))
    turn = np.concatenate(([0], np.cumsum((np.diff(down) != 0) | (np.diff(right) != 0))))
    return [*(_run_ends(on) + 1).tolist(), n], turn.tolist()


def _dates(value: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of dates, by start."""
    return sorted((*m.span(1), cost) for shape, cost in _DATES for m in shape.finditer(value))


def guess_cost(value: str, words: ahocorasick.Automaton) -> float:
    """log10 of the guesses for the cheapest segmentation into words, dates, repeats, walks and brute-force spans.

    The minimum is over all segmentations: repeats and walks of every length, words, dates and brute force anywhere. One pass
    over the value; repeats and walks keep the few starts that can still be the cheapest (``_Starts``). An empty value costs 0.
    Each further segment costs a factor of two for the choice of its place.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.translate(_LOWER)
    glue = math.log10(2)
    costs = {c: _class_cost(c) for c in set(value)}
    price = [costs[c] for c in value]
    cps = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    dates = iter([*_dates(value), (n, 0, 0.0)])
    runs = _repeats(cps) if n > 1 else {}
    reach, turn = _walks(low.translate(_SHIFTED)) if n > 2 else ([0] * n, [])
    found = words.iter(low) if len(words) else iter(())
    capitals = None
    if low != value:
        capitals = np.concatenate(([0], np.cumsum((cps >= 65) & (cps <= 90)))).tolist()
    date, word = next(dates), next(found, (n, None))
    best = [math.inf] * (n + 1)
    best[0] = before = 0.0
    entry = [0.0]  # best, with the factor for the place of a next segment
    brute = math.inf  # the cheapest way that ends in a brute-force span: only its first character pays for the place
    repeats: list[tuple[int, int, float, list[_Starts]]] = []
    walk, walk_end, key, change = None, 0, math.log10(47), math.log10(8)
    for i in range(n):
        while date[0] == i:
            if before + date[2] < best[date[1]]:
                best[date[1]] = before + date[2]
            date = next(dates)
        for end, start, width in runs.get(i, ()):
            repeats.append((end, width, sum(price[start : start + width]) - math.log10(width), [_Starts(2 * width) for _ in range(width)]))
        brute = (brute if brute < before else before) + price[i]
        least, j = best[i + 1], i + 1
        if brute < least:
            least = brute
        if repeats:  # a unit in any rotation, as often as one likes
            repeats = [r for r in repeats if r[0] > i]
            for end, width, unit, starts in repeats:
                starts[i % width].add(i, before)
                cost = starts[j % width].best(j) + unit
                if cost < least:
                    least = cost
        if reach[i] > i + 1:  # on a walk
            if walk is None or i >= walk_end:
                walk, walk_end = _Starts(3), reach[i]
            walk.add(i, before - turn[i] * change)
        if walk is not None and j <= walk_end and j >= 3:
            cost = walk.best(j) + key + (1 + turn[j - 2]) * change
            if cost < least:
                least = cost
        while word[0] == i:
            size, cost = word[1]
            start = j - size
            if capitals and (upper := capitals[j] - capitals[start]):  # a factor for capitals
                cost += glue if upper == size or upper == 1 and capitals[start + 1] > capitals[start] else size * glue
            cost += entry[start]
            if cost < least:
                least = cost
            word = next(found, (n, None))
        best[j] = least
        before = least + glue
        entry.append(before)
    return best[n]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def guessed_spans(text: str, base: list[tuple[int, str, int]], words: ahocorasick.Automaton, min_cost: float = MIN_COST) -> list[tuple[int, str, int]]:
    """Values after credential words that overlap no base span and cost at least ``min_cost`` (log10 of guesses)."""
    if not (":" in text or "=" in text or " is " in text or "--" in text):
        return []
    out, far = [], list(accumulate((e for _, _, e in base), max))
    starts = [s for s, _, _ in base]
    last = -1
    for m in sorted((m for context in CONTEXTS for m in context.finditer(text)), key=lambda m: m.span(1)):
        a = m.start(1)
        value = m.group(1).rstrip(".,;:!?)]}>")
        b = a + len(value)
        k = bisect_left(starts, b)  # base spans that begin before the value ends; the farthest of their ends
        if len(value) >= 6 and a >= last and not (k and far[k - 1] > a) and guess_cost(value, words) >= min_cost:
            out.append((a, "guess", b))
            last = b
    return out


def joined(spans: Iterable[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def redact(text: str, spans: Iterable[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal union of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for a, _, b in sorted(spans):
        if a >= end:
            out += [text[at:a], mark]
            end = at = b
        elif b > end:
            end = at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST, redacted: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts of the base kinds and of the model's, base and all spans as
    ``kind:start:end`` by start (code points, end exclusive), the highest guess cost, and on wish the redacted text.

    Null texts count as empty (no span). Ties in start go by kind in the order assign, access, hex, guess.
    Repeated rows each get their row; other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about a megabyte
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        words = word_finder(word_ranks(shipped.value))
        for b in text_slices(batches, "text"):
            rows = []
            for text in texts_of(b, "text"):
                base = base_spans(text)
                more = guessed_spans(text, base, words, min_cost)
                kinds = [k for _, k, _ in base]
                cost = max((guess_cost(ASSIGN.match(text, a).group(2) if k == "assign" else text[a:e], words) for a, k, e in [*base, *more]), default=0.0)
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), joined(base), joined([*base, *more]), cost, redact(text, [*base, *more]) if redacted and (base or more) else text if redacted else None))
            cols = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base", "spans", "max_cost", "redacted"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string, max_cost double, redacted string")


def secrets_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The digest of ``scan``: base spans as a SHA-256."""
    return scan(docs, vocabulary).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess", "max_cost")


def mask_secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with every secret replaced by a mark in ``text``; other columns stay, but ``n_chars`` is counted anew if there is one.

    One pass: the text is rewritten in place, batch by batch. Null texts stay null.
    """
    with open(vocabulary, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        words = word_finder(word_ranks(shipped.value))
        for b in text_slices(batches, "text"):
            out = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = [*base, *guessed_spans(text, base, words)]
                    text = redact(text, spans) if spans else text
                out.append(text)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
