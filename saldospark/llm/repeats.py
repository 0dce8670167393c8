"""Exact removal of long repeats: every byte that a 100-byte string covers which also starts earlier.

The question is which 100-byte strings (windows) are not the first of their kind, in the order of (id, place).
A suffix array of the collection would tell, but building it column by column takes as many rounds as the longest
document has bytes (see README); so windows are grouped by content in another way, with the same exact result.

Anchors: of the ``WINDOW - GRAM + 1`` short strings (``GRAM`` bytes) in a window, the one with the least hash, leftmost
first, is its anchor. Equal windows have equal anchors at the same offset, and the windows of one anchor occurrence
are a run; the bytes they cover together are its cover. So an anchor that occurs once has no repeated window;
one whose occurrences all have the same cover ("pure") has them all repeated but for the first occurrence; only
where covers differ ("mixed", at the edges of repeats) must windows be compared one by one. There the covers, aligned at
their anchors, go through a column-wise construction (see ``columns``) that inserts one symbol per cover in each round and
updates transform and common prefixes; neighbours with a common prefix of ``WINDOW`` bytes hold equal windows.

A batch of documents sends a row for each distinct anchor, so frequent passages are combined before the shuffle and rows grow
with the text. Anchors are counted and their states found by a native window over the anchor, in one shuffle;
an anchor that stands in no other batch and once in its own needs no answer. For mixed anchors a batch sends each distinct
cover once, as bytes. An anchor of more than ``HOT`` occurrences is "crowded": its covers would all meet in one
construction, so its windows are rows of their own, dealt by a hash of their bytes, and the bytes tell the first of each kind.
That is as exact, and no task gets one passage whole.

Anchors, and the covers of pure ones, are told apart by 64-bit hashes; windows at edges by their bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import batches, mix, prefix_hash, span_hash, text_bytes, whole_batches
from .columns import window_groups
from .common import materialize

WINDOW, GRAM = 100, 32
HOT = 5_000
BATCH_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
STEP = 1 << 18  # places of a text that are looked at together
LATER, FIRST, MIXED, CROWDED = range(1, 5)  # states of an anchor; 0: it occurs once


def anchors(text: bytes) -> tuple[np.ndarray, ...] | None:
    """(first window, last window, hash of the anchor, hash of the cover, place of the anchor in the cover) of every anchor occurrence; None below ``WINDOW`` bytes.

    Works through the text in steps, with some 10 bytes of memory a byte besides.
    """
    windows = len(text) - WINDOW + 1
    if windows <= 0:
        return None
    data, anchor = np.frombuffer(text, np.uint8), np.empty(windows, np.int64)
    for a in range(0, windows, STEP):
        b = min(windows, a + STEP)
        prefix = prefix_hash(data[a : b + WINDOW - 1])
        place = np.arange(b - a + WINDOW - GRAM)
        h = span_hash(prefix, place, place + GRAM)
        least = (h >> np.uint64(20) << np.uint64(20)) | place.astype(np.uint64)  # least hash, then leftmost
        span, width = WINDOW - GRAM + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor[a:b] = (least & np.uint64((1 << 20) - 1)).astype(np.int64) + a
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], windows) - 1
    at = anchor[first]
    h, cover = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64)
    step = first // STEP
    for k in range(int(step[-1]) + 1):
        i = slice(*np.searchsorted(step, [k, k + 1]))
        if i.start < i.stop:
            base = first[i.start]
            prefix = prefix_hash(data[base : last[i.stop - 1] + WINDOW])
            h[i] = span_hash(prefix, at[i] - base, at[i] - base + GRAM)
            cover[i] = span_hash(prefix, first[i] - base, last[i] - base + WINDOW)
    cover = mix(cover + (at - first).astype(np.uint64))
    return first, last, mix(h + np.uint64(0x9E3779B97F4A7C15)), cover, at - first  # least hashes crowd the low partitions: mixed anew


class Batch:
    """The documents of a batch in the order of their ids (null last), as one run of bytes, with all anchors."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, i))
        self.texts = [texts[i] for i in self.order]
        self.ids = np.array([np.iinfo(np.int64).max if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        parts = [(k, a) for k, t in enumerate(self.texts) if (a := anchors(t)) is not None]
        empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
        self.first, self.last, self.hash, self.cover, self.shift = (
            np.concatenate(c) if parts else e
            for c, e in zip(zip(*((a[0] + self.begin[k], a[1] + self.begin[k], *a[2:]) for k, a in parts)) if parts else empty, empty)
        )
        self.keys, self.where, self.back, self.count = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def covers(self, state: np.ndarray, wanted: int) -> np.ndarray:
        """The first occurrence of each distinct cover of the anchors in a state, by hash of the anchor."""
        at = np.flatnonzero(state[self.back] == wanted)
        _, first = np.unique(np.stack((self.back[at].astype(np.uint64), self.cover[at])), axis=1, return_index=True) if len(at) else (None, at)
        at = np.sort(at[first])
        return at[np.argsort(self.hash[at], kind="stable")]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The places of all windows of some anchor occurrences."""
        return ramp(self.first[at], self.last[at] - self.first[at] + 1)


def ramp(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] values, then the same for the next."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


ANCHOR_ROWS = "hash long, batch long, place long, doc long, n long, low long, differ long"
EDGE_ROWS = "hash long, batch long, place long, doc long, first long, size int, shift int, data binary"


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def anchor_rows(key: int, place: int, b: Batch) -> pa.Table:
    """A row for each distinct anchor: its number, least and greatest cover, and the id of the document where it first stands."""
    by = np.argsort(b.back, kind="stable")
    edges = np.searchsorted(b.back[by], np.arange(len(b.keys)))
    cover = b.cover[by].view(np.int64)  # signed, as the window over all batches compares them
    low, high = (f.reduceat(cover, edges) if len(by) else np.zeros(0, np.int64) for f in (np.minimum, np.maximum))
    doc = b.ids[b.doc(b.first[b.where])] if len(b.where) else np.zeros(0, np.int64)
    here = np.ones(len(b.keys), np.int64)
    return _table(ANCHOR_ROWS, hash=b.keys.view(np.int64), batch=here * key, place=here * place, doc=doc, n=b.count.astype(np.int64), low=low, differ=low ^ high)  # nearly always 0, which costs no bytes in the shuffle


def anchor_states(rows: DataFrame, hot: int) -> DataFrame:
    """(batch, hash, state) of the anchors that occur more than once."""
    own = Window.partitionBy("hash")
    lead = F.min(F.struct("doc", "place", "batch")).over(own).alias("lead")
    all_ = rows.select("*", F.sum("n").over(own).alias("total"), F.min("low").over(own).alias("least"), F.max(F.col("low").bitwiseXOR(F.col("differ"))).over(own).alias("most"), lead).where("total > 1")
    first = (F.col("lead.doc") == F.col("doc")) & (F.col("lead.place") == F.col("place")) & (F.col("lead.batch") == F.col("batch"))
    state = F.when(F.col("least") != F.col("most"), F.when(F.col("total") > hot, CROWDED).otherwise(MIXED)).when(first, FIRST).otherwise(LATER)
    return all_.select("batch", "hash", state.cast("int").alias("state"))


def state_of(b: Batch, hashes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The state of each of the batch's distinct anchors."""
    out = np.zeros(len(b.keys), np.uint8)
    at = np.searchsorted(b.keys, hashes)
    if len(hashes) and (at[-1] >= len(b.keys) or (b.keys[at] != hashes).any()):
        raise ValueError("the batches of the two plans differ: pass files or a checkpoint")
    out[at] = states
    return out


def edge_rows(key: int, place: int, b: Batch, state: np.ndarray) -> pa.Table:
    """What must be compared window by window: covers of mixed anchors, and windows of crowded ones (size 0)."""
    data = b"".join(b.texts)
    at = b.covers(state, MIXED)
    first, last = b.first[at], b.last[at]
    windows = b.windows(b.covers(state, CROWDED))
    once: dict[bytes, int] = {}
    for p in np.sort(windows).tolist():
        once.setdefault(data[p : p + WINDOW], p)
    where = np.concatenate((first, np.fromiter(once.values(), np.int64, len(once))))
    here = np.ones(len(where), np.int64)
    zero = np.zeros(len(once), np.int64)
    return _table(
        EDGE_ROWS, hash=np.concatenate((b.hash[at].view(np.int64), zero)), batch=here * key, place=here * place, doc=b.ids[b.doc(where)] if len(where) else where, first=where,
        size=np.concatenate((last - first + 1, zero)), shift=np.concatenate((b.shift[at], zero)),
        data=[data[f : e + WINDOW] for f, e in zip(first.tolist(), last.tolist())] + list(once),
    )


def earliest(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """True for the first member of each group in the given order."""
    by = np.lexsort((*reversed(order), group))
    lead = np.ones(len(by), bool)
    lead[1:] = group[by][1:] != group[by][:-1]
    out = np.zeros(len(by), bool)
    out[by[lead]] = True
    return out


def edge_answers(table: pa.Table) -> pa.Table:
    """(batch, first, later) for each cover of a bucket: a bit for each of its windows, whether it isn't the first of its kind.
    Of single windows (size 0) only those that are the first of their kind are named, with ``later`` null.

    Covers are aligned at their anchors, so that equal windows stand in one column, and compared by a column-wise
    construction over the bucket's distinct covers.
    """
    apart = table.filter(pc.equal(table["size"], 0))
    table = table.filter(pc.greater(table["size"], 0))
    seen: set[bytes] = set()
    leads = []
    for i in np.lexsort([apart[c].to_numpy() for c in ("first", "place", "doc")]).tolist():
        if (window := apart["data"][i].as_py()) not in seen:
            seen.add(window)
            leads.append(i)
    lead_rows = apart.take(pa.array(leads, pa.int64()))
    found = pa.table({"batch": lead_rows["batch"], "first": lead_rows["first"], "later": pa.nulls(len(leads), pa.binary())})
    if not table.num_rows:
        return found
    size, shift, data = (table[c].to_pylist() for c in ("size", "shift", "data"))
    known = {c: i for i, c in enumerate(dict.fromkeys(zip(shift, data)))}
    column = WINDOW - GRAM - np.array([s for s, _ in known], np.int64)
    group = window_groups([c for _, c in known], column, WINDOW)
    count = np.array([len(c) - WINDOW + 1 for _, c in known], np.int64)
    use, n = np.array([known[c] for c in zip(shift, data)]), np.array(size, np.int64)
    doc, place, first = (np.repeat(table[c].to_numpy(), n) for c in ("doc", "place", "first"))
    lead = earliest(group[ramp((np.cumsum(count) - count)[use], count[use])], doc, place, first + ramp(np.zeros(len(n), np.int64), n))
    parts = np.split(~lead, np.cumsum(n)[:-1])
    covers = pa.table({"batch": table["batch"], "first": table["first"], "later": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})
    return pa.concat_tables([found, covers])


def repeated(b: Batch, state: np.ndarray, later: dict[int, bytes], lead: np.ndarray) -> np.ndarray:
    """A mask over the batch's bytes: covered by a window that starts earlier elsewhere.

    ``later``: the bits of each cover of a mixed anchor, by its place; ``lead``: the places of crowded anchors' windows that
    are the first of their kind.
    """
    change = np.zeros(b.begin[-1] + 1, np.int32)

    def cover(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(change, first, 1)
        np.add.at(change, last + WINDOW, -1)

    s = state[b.back]
    own = np.zeros(len(s), bool)
    own[b.where] = True
    whole = (s == LATER) | ((s == FIRST) & ~own)
    mixed, crowded = b.covers(state, MIXED), b.covers(state, CROWDED)
    edge = np.zeros(len(s), bool)
    edge[mixed] = edge[crowded] = True
    whole |= ((s == MIXED) | (s == CROWDED)) & ~edge
    cover(b.first[whole], b.last[whole])
    for f, e in zip(b.first[mixed].tolist(), b.last[mixed].tolist()):
        place = f + np.flatnonzero(np.unpackbits(np.frombuffer(later[f], np.uint8), count=e - f + 1))
        cover(place, place)
    place = b.windows(crowded)
    place = place[~np.isin(place, lead)]
    cover(place, place)
    return np.cumsum(change[:-1]) > 0


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): a row for each row of ``docs``.

    Texts are UTF-8 bytes; null counts as empty. A byte is removed if a ``WINDOW``-byte string covers it that also
    starts earlier: in a document with a smaller id, or earlier in the same one. Rows that repeat an id are
    documents in the order of their place in the input (partition, then row); null ids come last. ``kept`` (the remaining
    bytes) is null unless asked for. Ids are integers. ``docs`` must be a stable relation (files or a checkpoint). A text
    is never split: a task takes some 30 bytes of memory for each byte of its longest text, so texts of 20 MB need 600 MB.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))

    def send(source):
        for key, place, ids, texts in batches(source, batch_bytes):
            yield from anchor_rows(key, place, Batch(ids.to_pylist(), texts)).to_batches()

    def pack(table: pa.Table) -> pa.Table:
        """A batch's states in one row, by hash: a checkpoint of rows would be larger than the text."""
        h = table["hash"].to_numpy().view(np.uint64)
        by = np.argsort(h)
        return pa.table({"batch": table["batch"][:1], "hashes": [h[by].tobytes()], "states": [table["state"].to_numpy()[by].astype(np.uint8).tobytes()]})

    def opened(left: pa.Table, hashes: list, states: list):
        """Each batch with the states of its anchors."""
        if left.num_rows == 0:
            raise ValueError("the batches of the two plans differ: pass files or a checkpoint")
        h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in hashes)])
        s = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in states)])
        for row in left.to_pylist():
            b = Batch(row["ids"], [t or b"" for t in row["texts"]])
            yield row, b, state_of(b, h, s)

    def edges(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([edge_rows(row["batch"], row["place"], b, state) for row, b, state in opened(left, right["hashes"].to_pylist(), right["states"].to_pylist())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n, gone, spans, sha, kept = [], [], [], [], [], []
        rows = right.to_pylist()
        later = {r["first"]: r["later"] for r in rows if r["later"] is not None}
        lead = np.array([r["first"] for r in rows if r["later"] is None and r["hashes"] is None], np.int64)
        known = [r for r in rows if r["hashes"] is not None]
        for row, b, state in opened(left, [r["hashes"] for r in known], [r["states"] for r in known]):
            mask = repeated(b, state, later, lead)
            for k, t in enumerate(b.texts):
                m = mask[b.begin[k] : b.begin[k + 1]]
                rest = np.frombuffer(t, np.uint8)[~m].tobytes()
                ids.append(row["ids"][b.order[k]])
                n.append(len(t))
                gone.append(len(t) - len(rest))
                spans.append(int(np.count_nonzero(np.diff(m.astype(np.int8), prepend=0) == 1)))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
        return pa.table({"doc_id": pa.array(ids, left.schema.field("ids").type.value_type), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})

    found = anchor_states(text_bytes(docs, id_col, text_col).mapInArrow(send, ANCHOR_ROWS), hot)
    states = materialize(found.groupBy("batch").applyInArrow(pack, "batch long, hashes binary, states binary"))
    whole = whole_batches(docs, id_col, text_col, batch_bytes)
    asked = whole.groupBy("batch").cogroup(states.groupBy("batch")).applyInArrow(edges, EDGE_ROWS)
    bucket = F.pmod(F.when(F.col("size") > 0, F.col("hash")).otherwise(F.xxhash64("data")), F.lit(buckets))
    edge = asked.groupBy(bucket).applyInArrow(edge_answers, "batch long, first long, later binary")
    nothing = F.lit(None).cast("binary")
    answers = states.select("batch", F.lit(None).cast("long").alias("first"), nothing.alias("later"), "hashes", "states").unionByName(
        edge.select("batch", "first", "later", nothing.alias("hashes"), nothing.alias("states"))
    )
    return whole.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
