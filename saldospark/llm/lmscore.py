"""Language-model scoring: stupid backoff over n-gram counts of the whole corpus.

An n-gram of order n scores count(n-gram) / count(its context), or ``BACKOFF`` times the score of the order below
where the count is 0; order 0 is the empty n-gram, whose count is the number of words, and below it stands
1 / (count + 1). A document is scored against all others: its own occurrences are taken off every count.

The n-grams of the highest order are rows, one for each document and n-gram, and are dealt out by context: there an n-gram and its
context get their counts in one sort. Contexts that make up more than 1 / ``HOT`` of all words are counted before and dealt
out by n-gram. Rows whose n-gram stands in no other document go on to the order below and are joined to its count
table, which is combined for each batch before its shuffle. The logarithms are summed by document.

The contexts are taken in ``SLICES`` by their hash, one after the other: what is shuffled for a slice is removed when its
sums stand, so the disk holds the n-grams of one slice at a time. The text is read anew for each slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import mix, prefix_hash, span_hash, text_bytes
from .common import materialize, text_slices

ORDER, BACKOFF = 2, 0.4
BATCH_BYTES = 6 << 20
ROWS = 1 << 16  # of an Arrow batch
SLICES, HOT, SPLITS = 4, 1024, 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BEGIN = np.uint64(0x5851F42D4C957F2D)


def words(texts: list[bytes], slice_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than ASCII white space) and the number of words of each text."""
    hashes, counts, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= slice_bytes):
            size += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b" ".join([*texts[at:end], b""]), np.uint8)
        inside = ~_WHITE[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(span_hash(prefix_hash(data), start, stop))
        ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts.append(np.diff(np.searchsorted(start, ends), prepend=0))
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(document of each word, number of words of each document, per order 1.. the hashes of the n-gram that ends
    at each word and of its context). Before a document's first word stand marks of the beginning."""
    w, n = words(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(w)) - first
    levels = [(mix(w ^ np.uint64(1)), np.zeros(len(w), np.uint64))]
    context = np.zeros(len(w), np.uint64)
    for k in range(1, order):
        # the context of length k: the word k places before, then the rest of the context
        before = np.where(place >= k, w[np.maximum(np.arange(len(w)) - k, 0)], _BEGIN)
        context = mix(context * np.uint64(0x2545F4914F6CDD1D) + before)
        tag = mix(context ^ np.uint64(k + 1 << 8))
        levels.append((mix(tag * np.uint64(0xD1342543DE82EF95) + w), tag))
    return doc, n, levels


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of each action when it ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def numbered(source: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[np.ndarray, pa.Array, list[bytes]]]:
    """(numbers, ids, texts) of slices of a scan partition; a document's number is made of the partition and its place there."""
    at = TaskContext.get().partitionId() << 33
    for b in text_slices(source, "text", max_bytes):
        yield np.arange(at, at + b.num_rows), b.column(0), [t or b"" for t in b.column(1).to_pylist()]
        at += b.num_rows


def in_document(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return key + mix(doc.astype(np.uint64) + np.uint64(1))


def own_counts(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every word how often its document has its key."""
    _, back, n = np.unique(in_document(doc, key), return_inverse=True, return_counts=True)
    return n[back]


def columns(order: int) -> list[str]:
    """The keys and own counts of the orders below the highest: n-gram g and its count o, context c and its count p."""
    return [f"{x}{k}" for k in range(order - 1, 0, -1) for x in ("gocp" if k > 1 else "go")]


def arrow(data: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64)) for k, v in data.items()})
    for a in range(0, whole.num_rows, ROWS):
        yield whole.slice(a, ROWS)


def key_counts(docs: DataFrame, order: int) -> DataFrame:
    """(key, top, total): counts of the n-grams and contexts below the highest order, and of the contexts of the highest (top = 1)."""

    def run(source):
        for _, _, texts in numbered(source, BATCH_BYTES):
            levels = ngrams(texts, order)[2]
            below = [levels[0][0]] + [k for level in levels[1:-1] for k in level]
            for top, keys in ((0, below), (1, [levels[-1][1]] if order > 1 else [])):
                if keys:
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield from arrow({"key": key, "top": np.full(len(key), top), "n": n})

    return docs.mapInArrow(run, "key long, top long, n long").groupBy("key", "top").agg(F.sum("n").alias("total"))


def top_rows(docs: DataFrame, order: int, part: int, hot: list[tuple[int, int]]) -> DataFrame:
    """A row for each document and n-gram of the highest order whose context (order 1: which itself) is in the slice ``part``.

    Columns: context (of a hot one, a part of it) and its total if it is hot (else 0), document, count there, own count
    of the context, and ``columns(order)``.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(sorted(hot))

    def run(source):
        known = np.array([k for k, _ in shipped.value], np.int64)
        total = np.array([n for _, n in shipped.value], np.int64)
        for number, _, texts in numbered(source, 1 << 20):
            doc, _, levels = ngrams(texts, order)
            gram, context = levels[-1]
            mine = np.flatnonzero(((context if order > 1 else gram) >> np.uint64(20)) % np.uint64(SLICES) == part)
            _, first, n = np.unique(in_document(doc[mine], gram[mine]), return_index=True, return_counts=True)
            at = mine[first]
            own = np.zeros(len(doc), np.int64)
            own[mine] = own_counts(doc[mine], context[mine])
            low = levels[max(order - 2, 0)][0][at]
            key, base = context[at].copy(), np.zeros(len(at), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, key.view(np.int64)), len(known) - 1)
                is_hot = known[place] == key.view(np.int64)
                base[is_hot] = total[place[is_hot]]
                key[is_hot] = mix(key[is_hot] + (low[is_hot] >> np.uint64(20)) % np.uint64(SPLITS) + np.uint64(1))
            out = {"context": key, "base": base, "doc": number[doc[at]], "n": n, "own": own[at]}
            for k in range(order - 1, 0, -1):
                g, c = levels[k - 1]
                out |= {f"g{k}": g[at], f"o{k}": own_counts(doc, g)[at]}
                if k > 1:
                    out |= {f"c{k}": c[at], f"p{k}": own_counts(doc, c)[at]}
            if order == 1:
                out |= {"g1": gram[at], "o1": n}
            yield from arrow(out)

    names = ["context", "base", "doc", "n", "own", *(columns(order) or ["g1", "o1"])]
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def slice_sums(rows: DataFrame, counts: DataFrame, order: int, backoff: float) -> DataFrame:
    """(doc, words, s, seen, unseen): of the words of a slice their number, the sum of logarithms without the division by the number of
    words, and how many of them are divided by it (``seen``) or by one more (``unseen``)."""
    names = columns(order) or ["g1", "o1"]
    zero = F.lit(0.0)
    if order > 1:
        gram = F.sum("n").over(Window.partitionBy("context", f"g{order - 1}")) - F.col("n")
        base = F.when(F.col("base") > 0, F.col("base")).otherwise(F.sum("n").over(Window.partitionBy("context")))
        # one exchange and one sort serve both windows
        rows = rows.repartition("context").withColumn("c", gram).withColumn("b", base - F.col("own"))
        found = F.col("c") > 0
        # what is found is combined by document; the rest keeps its row
        kept = [F.when(~found, F.col(c)).otherwise(F.xxhash64("doc") if c[0] in "gc" else None).alias(c) for c in names]
        rows = rows.select("doc", found.alias("done"), *kept, "n", F.when(found, F.col("n") * F.log(F.col("c") / F.col("b"))).otherwise(zero).alias("s"))
        rows = rows.groupBy("doc", "done", *names).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    else:
        rows = rows.select("doc", F.lit(False).alias("done"), *names, "n", zero.alias("s"))
    for k in range(order - 1, 1, -1):
        for x, own in (("g", "o"), ("c", "p")):
            table = counts.select(F.col("key").alias(f"{x}{k}"), F.col("total").alias(f"t{x}"))
            rows = rows.join(table, f"{x}{k}", "left").withColumn(f"t{x}", F.coalesce(f"t{x}", F.col(f"{own}{k}")) - F.col(f"{own}{k}"))
        found = ~F.col("done") & (F.col("tg") > 0)
        value = F.when(found, F.col("n") * (F.log(F.col("tg") / F.col("tc")) + (order - k) * math.log(backoff))).otherwise(F.col("s"))
        rows = rows.withColumn("s", value).withColumn("done", F.col("done") | F.coalesce(found, F.lit(False))).drop("tg", "tc")
    # a partition of the count table is small beside the rows that seek in it, so it is hashed and they need no sort
    last = rows.join(counts.select(F.col("key").alias("g1"), "total").hint("shuffle_hash"), "g1", "left").withColumn("c", F.coalesce("total", "o1") - F.col("o1"))
    seen, unseen = ~F.col("done") & (F.col("c") > 0), ~F.col("done") & (F.col("c") <= 0)
    value = F.when(seen, F.col("n") * (F.log("c") + (order - 1) * math.log(backoff))).when(unseen, F.col("n") * (order * math.log(backoff))).otherwise(F.col("s"))
    return last.groupBy("doc").agg(
        F.sum("n").alias("words"), F.sum(value).alias("s"), F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("seen"), F.sum(F.when(unseen, F.col("n")).otherwise(0)).alias("unseen")
    )


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score): a row for each row of ``docs``; natural logarithms, 0 for a text without words.

    Null texts count as empty. Rows that repeat an id or a text are documents of their own. ``docs`` must be a
    stable relation (files or a checkpoint): documents are known by their place in it, and where two passes see
    different ones the query fails. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = text_bytes(docs, id_col, text_col)

    def number(source):
        for numbers, ids, batch in numbered(source, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(numbers), ids, pa.array(words(batch)[1].astype(np.int64))], names=["doc", "doc_id", "n_words"])

    with shuffles_removed(docs.sparkSession):
        base = materialize(texts.mapInArrow(number, f"doc long, doc_id {id_type}, n_words long"))
        all_words = base.agg(F.sum("n_words")).first()[0] or 0
        # a count of 1 is the document's own, which is taken off: as good as none
        counts = materialize(key_counts(texts, order).where(((F.col("top") == 0) & (F.col("total") > 1)) | (F.col("total") > max(1, all_words / HOT))))
        hot = [(r["key"], r["total"]) for r in counts.where("top = 1").collect()]  # HOT at most
        below = counts.where("top = 0").select("key", "total")
        sums = [materialize(slice_sums(top_rows(texts, order, part, hot), below, order, backoff)) for part in range(SLICES)]
    whole = reduce(DataFrame.unionByName, sums).groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("words", "s", "seen", "unseen")])
    others = F.lit(all_words) - F.col("n_words")
    value = F.col("s") - F.col("seen") * F.log(F.greatest(others, F.lit(1))) - F.col("unseen") * F.log(others + 1)
    odd = F.raise_error(F.lit("the passes over the documents differ: pass files or a checkpoint")).cast("double")
    log_score = F.when(F.coalesce("words", F.lit(0)) != F.col("n_words"), odd).otherwise(F.coalesce(value, F.lit(0.0)))
    return base.join(whole, "doc", "left").select("doc_id", "n_words", log_score.alias("log_score"))
