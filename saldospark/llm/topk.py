"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A term is a dimension. Candidates of a block form a posting list for each term (row, weight); query rows are
sparse lists of (term, weight). Each term's postings, times the queries' weights, are scattered into a dense
array of scores (queries x candidates). ``argpartition`` picks the best of a block, and a window merges blocks.

Equal rows are one row with a count. Queries and candidates are dealt into blocks by hash; a pair of blocks is one group of a
cogrouped map, so a task holds one block of each and nothing passes through the driver but two counts. Query blocks are
larger (``QUERIES`` times), since a candidate is sent once for each of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
QUERIES = 8
RESULT = "query_id long, key string, times long, vec_id long, score long, n long"


def quantize(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, w array<long>) with floor(1024 * x); rows with a null id, a null vector or a null or non-finite component are left out."""
    x = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    )
    return vectors.where(fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("w")
    )


def dense(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The vectors of a column of lists."""
    return [x for part in lists.chunks for x in np.split(part.flatten().to_numpy(), np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(part)]


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Dense scores (queries x candidates), one term after the other; missing terms weigh 0."""
    terms = max(map(len, [*queries, *candidates]), default=0)
    scores = np.zeros((len(queries), len(candidates)), dtype=np.int64)

    def lists(rows):
        dense = np.zeros((terms, len(rows)), dtype=np.int64)
        for i, r in enumerate(rows):
            dense[: len(r), i] = r
        return [(ids := np.flatnonzero(t), t[ids]) for t in dense]

    for (qi, qw), (ci, cw) in zip(lists(queries), lists(candidates)):
        if len(qi) and len(ci):
            if len(ci) == len(candidates):  # a full list needs no scatter
                for i, w in zip(qi, qw):
                    scores[i] += w * cw
            else:
                for i, w in zip(qi, qw):
                    scores[i, ci] += w * cw
    return scores


def best(scores: np.ndarray, ids: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, among those of which there are any."""
    at = np.flatnonzero(n > 0)
    s = scores[at]
    if len(at) > k:
        cut = s[np.argpartition(-s, k - 1)[:k]].min()
        keep = np.flatnonzero(s >= cut)
        at, s = at[keep], s[keep]
    return at[np.lexsort((ids[at], -s))[:k]]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id is divisible by ``every``.

    Candidates are all rows but the query's own; rows that repeat an id, or are equal, are rows of their own, as candidates and
    as queries. Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as
    padded with 0. An empty table gives no row. Components so large that a score could pass 64 bits raise an error.
    """
    rows = quantize(vectors, id_col, vec_col).groupBy("vec_id", "w").agg(F.count("*").alias("n")).withColumn("key", F.md5(F.array_join(F.col("w").cast("array<string>"), ",")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, nq = vectors.count(), vectors.where(F.pmod(F.col(id_col).cast("long"), F.lit(every)) == 0).count()
    c_blocks, q_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(nq / (block * QUERIES)))

    def spread(df, own, of, other, others):
        return df.select("vec_id", "w", "n", "key", F.pmod(F.xxhash64("vec_id", "key"), F.lit(of)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    q, c = spread(asked, "qb", q_blocks, "cb", c_blocks), spread(rows, "cb", c_blocks, "qb", q_blocks)

    def score(queries: pa.Table, found: pa.Table) -> pa.Table:
        out = {"query_id": [], "key": [], "times": [], "vec_id": [], "score": [], "n": []}
        if queries.num_rows and found.num_rows:
            ids, n, cand, asked_w = found["vec_id"].to_numpy(), found["n"].to_numpy(), dense(found["w"]), dense(queries["w"])
            place = {x: i for i, x in enumerate(zip(ids.tolist(), found["key"].to_pylist()))}
            largest = [max((int(np.abs(np.asarray(w, float)).max()) for w in x if len(w)), default=0) for x in (asked_w, cand)]
            if largest[0] * largest[1] * max(map(len, cand)) >= 1 << 63:
                raise OverflowError("components are too large for a score of 64 bits")
            for a in range(0, queries.num_rows, 128):
                part = queries.slice(a, 128)
                scores = accumulate(asked_w[a : a + 128], cand)
                for own, key, times, s in zip(*(part[c].to_pylist() for c in ("vec_id", "key", "n")), scores):
                    others = n
                    if (i := place.get((own, key))) is not None:  # one of these rows is the query's own
                        others = n.copy()
                        others[i] -= 1
                    at = best(s, ids, others, k)
                    for name, values in (("query_id", [own] * len(at)), ("key", [key] * len(at)), ("times", [times] * len(at)), ("vec_id", ids[at]), ("score", s[at]), ("n", others[at])):
                        out[name] += list(values)
        return pa.table({c: pa.array(x, pa.string() if c == "key" else pa.int64()) for c, x in out.items()})

    partial = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(score, RESULT)
    each = partial.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))  # of equal rows no more than k can be among the k best
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
