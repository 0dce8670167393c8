"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It labels every byte of a text; a document's
probabilities are the means over its bytes. A text is read whole, as windows of ``CORE`` bytes with ``EDGE`` bytes
of context on both sides (the state starts anew in each window), so that texts of any length are labelled in
batches of windows of one size and memory stays bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, text_slices, texts_of

HIDDEN = 8
CORE, EDGE = 160, 16
#: Bounds of the training sample: about so many documents per language, and bytes of all of them (no more, so fewer documents where texts
#: are long). Texts of the sample are read whole, in windows of ``WINDOW`` bytes; every ``DEV``-th document is kept for choosing the network.
SAMPLE_DOCS, SAMPLE_BYTES, WINDOW, DEV = 400, 16 << 20, 64, 10
BATCH, LEAST_STEPS = 128, 500
UNDETERMINED = "und"


@dataclass
class Network:
    """x: input weights by byte (256 x 3H, bias within), u: recurrent weights (H x 3H), for both directions; v, c: output layer."""

    langs: list[str]
    params: dict[str, np.ndarray]

    @staticmethod
    def new(langs: list[str], seed: int = 0) -> Network:
        r, h, k = np.random.default_rng(seed), HIDDEN, len(langs)
        p = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            p["u" + d] = r.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
        p["v"], p["c"] = r.normal(0, 0.3, (2 * h, k)).astype(np.float32), np.zeros(k, np.float32)
        return Network(langs, p)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    np.multiply(a, 0.5, out=a)
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def _run(x: np.ndarray, u: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T x B x H) of one direction over ``steps`` (T x B bytes)."""
    hidden = u.shape[0]
    h = np.zeros((steps.shape[1], hidden), np.float32)
    out = np.empty((*steps.shape, hidden), np.float32)
    for t in range(steps.shape[0]):
        a, g = np.take(x, steps[t], axis=0), h @ u
        zr = _sigmoid(a[:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        gn = g[:, 2 * hidden :]
        n = r * gn
        n += a[:, 2 * hidden :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((h, z, r, n, gn))
        h = np.subtract(h, n, out=out[t])
        h *= z
        h += n
    return out


def _back(u: np.ndarray, steps: np.ndarray, kept: list, dout: np.ndarray, dx: np.ndarray, du: np.ndarray) -> None:
    """Backpropagation through time of ``_run``: adds to the gradients dx and du."""
    hidden = u.shape[0]
    dh = np.zeros_like(dout[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        d = dout[t] + dh
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate((dz, dr, dn), axis=1)
        dg = np.concatenate((dz, dr, dn * r), axis=1)
        np.add.at(dx, steps[t], da)
        du += h.T @ dg
        dh = d * z + dg @ u.T


def position_probs(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities (languages x T x B) of every position of ``windows`` (B x T bytes)."""
    p, steps = net.params, np.ascontiguousarray(windows.T)
    f = _run(p["xf"], p["uf"], steps)
    b = _run(p["xb"], p["ub"], steps[::-1])[::-1]
    h = p["uf"].shape[0]
    logits = f.reshape(-1, h) @ p["v"][:h]
    logits += b.reshape(-1, h) @ p["v"][h:]
    probs = np.ascontiguousarray(logits.T)
    probs += p["c"][:, None]
    np.clip(probs, -60, 60, out=probs)
    np.exp(probs, out=probs)
    probs /= probs.sum(axis=0)
    return probs.reshape(-1, *steps.shape)


def window_loss(net: Network, windows: np.ndarray, labels: np.ndarray) -> float:
    """Mean cross-entropy over the positions of ``windows``, every language weighing the same."""
    loss = np.zeros(len(net.langs))
    for k in np.unique(labels):
        own = windows[labels == k]
        probs = position_probs(net, own)[k]
        loss[k] = -np.log(probs[own.T != 0] + 1e-9).mean()
    return float(loss[np.unique(labels)].mean())


def turns(labels: np.ndarray, batch: int, r: np.random.Generator):
    """Batches without end, of as many windows of each language; a language's windows all come once before one comes again."""
    groups = [np.flatnonzero(labels == k) for k in np.unique(labels)]
    each = max(1, batch // len(groups))
    left = [np.zeros(0, np.int64)] * len(groups)
    while True:
        pick = []
        for k, g in enumerate(groups):
            while len(left[k]) < each:
                left[k] = np.concatenate((left[k], r.permutation(g)))
            pick.append(left[k][:each])
            left[k] = left[k][each:]
        yield np.concatenate(pick)


def steps_for(labels: np.ndarray, batch: int = BATCH) -> int:
    """Steps in which the language with the most windows is read to the end."""
    _, sizes = np.unique(labels, return_counts=True)
    return max(LEAST_STEPS, -(-int(sizes.max(initial=0)) // max(1, batch // max(1, len(sizes)))))


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 500, batch: int = BATCH, rate: float = 0.02, seed: int = 0, dev: tuple[np.ndarray, np.ndarray] | None = None) -> Network:
    """Fit by Adam on the cross-entropy of every position; byte 0 (padding) has no weight.

    With ``dev`` (windows, labels of other documents) the network of the step with the least loss there is returned, and training
    ends when five looks in a row find nothing better.
    """
    net, r = Network.new(langs, seed), np.random.default_rng(seed)
    p, h = net.params, HIDDEN
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    best, kept_params, looks = np.inf, None, 0
    for step, pick in zip(range(1, steps + 1), turns(labels, batch, r)):  # every language weighs the same
        s, y = np.ascontiguousarray(windows[pick].T), labels[pick]
        kf, kb = [], []
        f, b = _run(p["xf"], p["uf"], s, kf), _run(p["xb"], p["ub"], s[::-1], kb)[::-1]
        both = np.concatenate((f, b), axis=2)
        logits = both @ p["v"] + p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(len(y)), y] -= 1
        weight = (s != 0)[:, :, None]
        d = (d * weight / max(1, weight.sum())).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["v"], grad["c"] = np.einsum("tbi,tbk->ik", both, d), d.sum(axis=(0, 1))
        dboth = d @ p["v"].T
        _back(p["uf"], s, kf, dboth[:, :, :h], grad["xf"], grad["uf"])
        _back(p["ub"], s[::-1], kb, dboth[::-1, :, h:], grad["xb"], grad["ub"])
        lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            np.clip(g, -0.5, 0.5, out=g)
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.01 * (g * g - m2[k])
            p[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        if dev is not None and len(dev[1]) and (step % 50 == 0 or step == steps):
            now, looks = window_loss(net, *dev), looks + 1
            if now < best:
                best, looks, kept_params = now, 0, {k: v.copy() for k, v in p.items()}
            elif looks >= 5:
                break
    if kept_params is not None:
        net.params = kept_params
    return net


def document_probs(net: Network, texts: list[str], batch: int = 4096) -> np.ndarray:
    """Mean probabilities over all bytes of each text; zeros for an empty one."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.array([len(x) for x in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum(lens)))
    n_win = -(-lens // CORE)
    doc = np.repeat(np.arange(len(texts)), n_win)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win)) * CORE
    out = np.zeros((len(texts), len(net.langs)))
    span = np.arange(-EDGE, CORE + EDGE)
    for a in range(0, len(doc), batch):
        d = doc[a : a + batch]
        place = at[a : a + batch, None] + span
        inside = (place >= 0) & (place < lens[d, None])
        windows = np.where(inside, flat[np.clip(first[d, None] + place, 0, max(0, len(flat) - 1))], 0)
        probs = position_probs(net, windows)[:, EDGE:-EDGE]
        probs = (probs * inside.T[EDGE:-EDGE]).sum(axis=1)
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(d, probs[k], minlength=len(texts))
    return out / np.maximum(lens, 1)[:, None]


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: tuple[int, int]) -> list[tuple[str, int, bytes]]:
    """(lang, key, text) of a bounded sample: about ``SAMPLE_DOCS`` documents per language and at most ``SAMPLE_BYTES`` in all, chosen by hash of the id.

    Each language has an equal share of the bytes, filled in the order of the hashes; a text longer than the share isn't learned from.
    """
    folds, out = held_out
    learn = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & (fold_of(id_col, folds) != out)).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")
    )
    counts = {r["lang"]: (r["n"], r["bytes"]) for r in learn.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, (n, size) in sorted(counts.items()) for x in (k, min(1.0, 1.2 * SAMPLE_DOCS / n, SAMPLE_BYTES / len(counts) / size))])
    chosen = learn.withColumn("key", F.xxhash64("id")).where(F.pmod("key", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    # one row for each id and language, so that the sample stays bounded where rows repeat an id
    once = chosen.where(F.octet_length("text") <= SAMPLE_BYTES // len(counts)).groupBy("lang", "key").agg(F.min("text").alias("text"))
    filled = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("key"))
    return sorted((r["lang"], r["key"], bytes(r["text"])) for r in once.withColumn("filled", filled).where(F.col("filled") <= SAMPLE_BYTES // len(counts)).collect())


def cut(text: bytes) -> np.ndarray:
    """A whole text as windows of ``WINDOW`` bytes; the last one ends with the text (a shorter text is padded)."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < WINDOW:
        return np.pad(data, (0, WINDOW - len(data)))[None, :]
    at = np.append(np.arange(0, len(data) - WINDOW, WINDOW), len(data) - WINDOW)
    return data[at[:, None] + np.arange(WINDOW)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (4, 2)) -> Network | None:
    """Train on a bounded sample of documents outside the held-out fold; None if there is nothing to learn from.

    The steps suffice to read every window of the sample; training ends before that only where the documents set aside show no
    more gain (see ``train``).
    """
    rows = training_texts(docs, id_col, text_col, lang_col, held_out)
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    parts = [cut(r[2]) for r in rows]
    windows, labels = np.concatenate(parts), np.repeat([langs.index(r[0]) for r in rows], [len(x) for x in parts])
    nth = np.array([k for lang in langs for k in range(sum(r[0] == lang for r in rows))])  # within its language: rows are sorted by it
    dev = np.repeat(nth % DEV == DEV - 1, [len(x) for x in parts])
    return train(windows[~dev], labels[~dev], langs, steps=steps_for(labels[~dev]), dev=(windows[dev], labels[dev]))


def label_texts(net: Network | None, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; ``und`` and 0 without a letter (or without a network)."""
    if net is None:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    probs = document_probs(net, texts)
    best = probs.argmax(axis=1)
    lettered = [any(map(str.isalpha, t)) for t in texts]  # stops at the first letter
    return [net.langs[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)], [float(min(1.0, p[k])) if ok else 0.0 for p, k, ok in zip(probs, best, lettered)]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row for each row of ``docs``.

    Null, empty and letterless texts give ``und`` with score 0. ``held_out`` is null for a null id. Ties go to
    the language that sorts first. Repeated rows each get their row; other columns are not read.
    """
    shipped, id_type = docs.sparkSession.sparkContext.broadcast(net), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches, "text", 1 << 19):
            langs, scores = label_texts(shipped.value, texts_of(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
    return found.select("doc_id", (fold_of("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, net: Network | None, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language: not ``und`` and with a score of ``min_score`` or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in text_slices(batches, text_col, 1 << 19):
            langs, scores = label_texts(shipped.value, texts_of(b, text_col))
            yield b.filter(pa.array([lang != UNDETERMINED and s >= min_score for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
