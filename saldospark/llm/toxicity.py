"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, with exception phrases.

Folding undoes spellings that hide a word, and remembers the place of each character. Zero-width characters and
combining marks go; letters spelled out with one sign between them (b.a.d) close up; then each code point becomes a lower-case plain
letter: full-width and styled letters, accents, homoglyphs of other scripts, and digits and signs that stand for letters
inside a word. All else becomes a blank. A letter that stands three or more times in a row counts once, or, in a second
reading, twice (baaad, helll). The automaton holds the lexicon's words and the exception phrases, each between blanks.
A word inside an exception phrase doesn't count. The sum of the weights and the same per hundred words
("normalised by length") give a probability through a fitted logistic curve.

Lexicon, weights, exceptions and curve are learned from a bounded sample of labelled rows, which alone bounds their size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, fold_of, text_slices, texts_of

# Homoglyphs of Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁɡһԛԝьВМНТКАЕОРСХІЅαονικρτυβγηωϲ", "aeopcyxijsdghqwbbmhtkaeopcxisaovikptubynwc"))
LEET = dict(zip("01345678@$|!69", "oieasgtbasiigg"))
#: Bound of the training sample.
SAMPLE_ROWS = 20_000
#: Three or more single letters with one sign between each two.
SPELLED = re.compile(r"(?<![^\W_])[^\W\d_]([.\-_*·~+/,])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
MIN_DOCS, MIN_WEIGHT, PREDICT = 5, 3.0, 0.3


@lru_cache(maxsize=1)
def fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: the letter it folds to (a blank, or 0 if it goes), and the letter it may stand for inside a word (or 0)."""
    letters, signs = np.full(0x110000, 0x20, np.uint32), np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if cp < 0x80:
            if c.isalpha():
                letters[cp] = ord(c.lower())
        elif unicodedata.category(c) in ("Mn", "Me", "Cf"):
            letters[cp] = 0
        elif c.isalpha():
            base = HOMOGLYPHS.get(c) or HOMOGLYPHS.get(c.lower()) or unicodedata.normalize("NFKD", c).lower()
            letters[cp] = ord(base[0]) if base[0].isalpha() and all(unicodedata.combining(x) for x in base[1:]) else cp
    for c, to in LEET.items():
        signs[ord(c)] = ord(to)
    return letters, signs


def fold(cps: np.ndarray) -> np.ndarray:
    """Folded code points. A digit counts as a letter if a letter follows within two places; a sign also needs one before."""
    letters, signs = fold_tables()
    out = letters[cps]
    sign = signs[cps]
    at = np.flatnonzero(sign)
    if len(at):
        padded = np.concatenate((out, np.full(2, 0x20, np.uint32)))
        more = np.concatenate((sign, np.zeros(2, np.uint32)))
        follows = (padded[at + 1] != 0x20) | ((more[at + 1] != 0) & (padded[at + 2] != 0x20))
        digit = cps[at] < 0x40
        digit &= cps[at] >= 0x30
        before = (at > 0) & (padded[at - 1] != 0x20)
        ok = at[follows & (digit | before)]
        out = out.copy()
        out[ok] = sign[ok]
    return out


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a text, and the place of each."""
    cps = codepoints([text])[0]
    keep = fold_tables()[0][cps] != 0
    spelled = list(SPELLED.finditer(text if keep.all() else cps[keep].astype("<u4").tobytes().decode("utf-32-le", "replace")))
    place = np.flatnonzero(keep)
    if spelled:
        out = np.zeros(len(place), bool)
        for m in spelled:
            out[m.start() + 1 : m.end() : 2] = True
        place = place[~out]
    return fold(cps[place]), place


def readings(text: str) -> list[tuple[str, np.ndarray]]:
    """The folded text between blanks with the place of each character (the blanks in front and behind stand at -1 and
    the length); a second reading keeps two of a letter that stands three or more times in a row."""
    chars, place = plain(text)
    n = len(chars)
    again = np.zeros(n, bool)
    again[1:] = (chars[1:] == chars[:-1]) & (chars[1:] != 0x20)
    start = np.flatnonzero(~again)
    size = np.diff(np.append(start, n))
    nth = np.arange(n) - np.repeat(start, size)
    long = np.repeat(size >= 3, size)
    out = []
    for most in (1, 2) if long.any() else (1,):
        keep = ~long | (nth < most)
        line = " " + chars[keep].astype("<u4").tobytes().decode("utf-32-le", "replace") + " "
        out.append((line, np.concatenate(([-1], place[keep], [len(text)]))))
    return out


def folded(text: str) -> str:
    """A text's folded form between blanks, in the first reading."""
    return readings(text)[0][0]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.5)

    def automaton(self):
        a = ahocorasick.Automaton()
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None, p))
        for w, x in self.weights.items():
            a.add_word(f" {w} ", (len(w) + 2, x, w))
        if len(a):
            a.make_automaton()
        return a


def hits(automaton, text: str) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, word) in code points of ``text``; words inside exception phrases are left out."""
    if not len(automaton) or not text:
        return []
    words, spared = {}, []
    for line, place in readings(text):
        for last, (n, weight, word) in automaton.iter(line):
            a, b = int(place[last - n + 2]), int(place[last - 1]) + 1  # without the blanks around
            if weight is None:
                spared.append((a, b))
            else:
                words[a, b] = (a, b, weight, word)
    ends = list(accumulate((b for _, b in sorted(spared)), max))
    starts = [a for a, _ in sorted(spared)]
    return [h for h in (words[k] for k in sorted(words)) if not ((i := bisect_right(starts, h[0])) and ends[i - 1] >= h[1])]


def features(found: list[tuple[int, int, float, str]], text: str) -> tuple[float, float]:
    """log1p of the sum of weights, and of the sum per hundred words."""
    total = sum(h[2] for h in found)
    words = text.count(" ") + text.count("\n") + 1
    return math.log1p(total), math.log1p(100 * total / words)


def probability(curve: tuple[float, float, float], x: tuple[float, float]) -> float:
    a = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, a))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a small ridge; slopes below 0 are set to 0."""
    keep = [0, 1, 2]
    full = np.column_stack((np.ones(len(y)), x))
    while True:
        a, w = full[:, keep], np.zeros(len(keep))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (y - p) - ridge * w
            h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(keep))
            w += np.clip(np.linalg.solve(h, g), -2, 2)
        bad = [k for k, v in zip(keep, w) if k and v < 0]
        if not bad:
            out = dict(zip(keep, w))
            return tuple(float(out.get(k, 0.0)) for k in range(3))
        keep.remove(min(bad, key=lambda k: dict(zip(keep, w))[k]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held_out: tuple[int, int]) -> DataFrame:
    """(id, text, toxic) of about ``SAMPLE_ROWS`` labelled documents outside the held-out fold, by hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", held_out[0]) != held_out[1])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one row for each id, so that the sample stays bounded where rows repeat an id
    return texts.join(F.broadcast(some), F.col("id") == F.col("doc_id")).groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2), exceptions: tuple[str, ...] = ()) -> Model:
    """Learn the model. Near copies count once: of documents with one min-hash signature one is taken.

    A word enters the lexicon with at least ``MIN_DOCS`` toxic documents and a log-odds weight of ``MIN_WEIGHT``.
    A phrase of a lexicon word and a neighbour that stands in ``MIN_DOCS`` clean documents and in no toxic one
    becomes an exception. Without labels the lexicon is empty and every score is low.
    """
    rows = training_rows(docs, labels, id_col, text_col, held_out).persist()  # read three times; the bound of the sample holds

    def words(batches):
        import xxhash

        for b in text_slices(batches, "text"):
            sig, bags = [], []
            for text in texts_of(b, "text"):
                w = folded(text).split()
                sig.append(min(xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))) >> 1)
                bags.append(sorted(set(w)))
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), b.column(b.schema.get_field_index("toxic")).cast(pa.int32()), pa.array(bags, pa.list_(pa.string()))], names=["sig", "toxic", "bag"])

    bags = rows.mapInArrow(words, "sig long, toxic int, bag array<string>").groupBy("sig").agg(F.max(F.struct("toxic", "bag")).alias("s")).select("s.*").persist()
    sizes = bags.agg(F.sum("toxic"), F.count("*")).first()
    bad, all_ = sizes[0] or 0, sizes[1]
    model = Model()
    if bad and all_ > bad:
        good = all_ - bad
        per = bags.select("toxic", F.explode("bag").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        odds = F.log((F.col("t") + 0.5) / (bad - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (good - F.col("c") + 0.5))
        chosen = per.withColumn("weight", odds).where((F.col("t") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT))
        model.weights = {r["word"]: float(r["weight"]) for r in chosen.orderBy(F.desc("weight"), "word").collect()}  # MIN_DOCS documents of the sample each
    bags.unpersist()
    model.exceptions = [" ".join(folded(p).split()) for p in exceptions]
    if not model.weights:
        return model

    def neighbours(batches, lexicon=frozenset(model.weights)):
        for b in text_slices(batches, "text"):
            near = []
            for text in texts_of(b, "text"):
                line = folded(text).split()
                near.append(sorted({p for i, w in enumerate(line) if w in lexicon for p in (" ".join(line[i - 1 : i + 1]), " ".join(line[i : i + 2])) if " " in p}))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("toxic")).cast(pa.int32()), pa.array(near, pa.list_(pa.string()))], names=["toxic", "near"])

    seen = rows.mapInArrow(neighbours, "toxic int, near array<string>").select("toxic", F.explode("near").alias("p"))
    phrases = seen.groupBy("p").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where((F.col("t") == 0) & (F.col("n") >= MIN_DOCS))
    model.exceptions += [r["p"] for r in phrases.orderBy("p").collect()]

    def measure(batches, model=model):
        automaton = model.automaton()
        for b in text_slices(batches, "text"):
            x = [features(hits(automaton, text), text) for text in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("toxic")).cast(pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*x))], names=["toxic", "x1", "x2"])

    xy = rows.mapInArrow(measure, "toxic int, x1 double, x2 double").toPandas()  # the bounded sample: three numbers a row
    if xy["toxic"].nunique() == 2:
        model.curve = fit_curve(xy[["x1", "x2"]].to_numpy(), xy["toxic"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits): a row for each row of ``docs``.

    Null and empty texts have no hit and get the curve's lowest score. ``held_out`` is null for a null id.
    """
    shipped, id_type = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shipped.value
        automaton = model.automaton()
        for b in text_slices(batches, "text"):
            found = [(hits(automaton, t), t) for t in texts_of(b, "text")]
            p = [probability(model.curve, features(h, t)) for h, t in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([len(h) for h, _ in found], pa.int64())], names=["doc_id", "score", "n_hits"])

    done = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double, n_hits long")
    return done.select("doc_id", (fold_of("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "n_hits")
