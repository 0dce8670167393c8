"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative of each group.

Equal vectors are one class with a count. A class lies in the cell of its nearest centre and visits each other
cell whose border (the bisector of the two centres) is within ``REACH`` of it. A link between two cells is found if one of its
ends visits the other's cell. Two ends have a cosine of ``threshold`` or more, so they are at most sqrt(2 - 2 threshold) apart, and
one of them is within half of that of the border: with ``reach`` at 0.2237 no link is lost for a threshold of 0.9. The default is smaller:
a direction between neighbours that is random in 64 dimensions crosses a border at a slant, so 0.1 is more than three
standard deviations (README has the recall). Links found are exact cosines in double precision.

A cell is worked off in pairs of blocks of about ``BLOCK`` rows, one matrix product each; what comes out is a count and
the smallest node reached for each row that has a link, not the pairs. Classes within half the angle of their centre (the
core) are linked to each other for certain, so they are counted, not compared: a large group of near copies is linear. Centres that come
to lie close together are merged, so such a group has one centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

THRESHOLD = 0.9
REACH = 0.1
CELL = 512
CENTRES = 16_384
PER_CENTRE = 8
BLOCK = 2_048
ROUNDS = 8
MERGE = 0.95
PRODUCTS = 1 << 22


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, whatever their scale."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors of a column of lists; shorter lists count as padded with 0."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return unit(out)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """At most ``k`` unit centres of the unit vectors ``x``; no two have a cosine above ``MERGE``."""

    def apart(c: np.ndarray) -> np.ndarray:
        kept = c[:0]
        for at in range(0, len(c), 512):
            for row in c[at : at + 512][(c[at : at + 512] @ kept.T).max(axis=1, initial=-1) <= MERGE]:
                if (kept @ row).max(initial=-1) <= MERGE:
                    kept = np.vstack((kept, row))
        return kept

    def nearest(c: np.ndarray) -> np.ndarray:
        step = max(1, PRODUCTS // len(c))
        return np.concatenate([(x[a : a + step] @ c.T).argmax(axis=1) for a in range(0, len(x), step)])

    centres = apart(x[np.random.default_rng(seed).permutation(len(x))[: 2 * k]])[:k]
    for _ in range(rounds if len(centres) > 1 else 0):
        own = nearest(centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        centres = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], centres)
        centres = apart(centres)
    return centres


def visited(u: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre of each row, the cosine to it, and (rows x centres) which other cells it visits."""
    s = u @ centres.T
    home = s.argmax(axis=1)
    best = s[np.arange(len(u)), home]
    between = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 1e-30))
    near = (best[:, None] - s) <= reach * between
    near[np.arange(len(u)), home] = False
    return home, best, near


def _assigned(classes: DataFrame, centres: np.ndarray, width: int, threshold: float, reach: float) -> DataFrame:
    core_from = math.cos(math.acos(threshold) / 2) + 1e-9
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCTS // len(centres))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                home, best, near = visited(matrix(b.column(3), width), centres, reach)
                row, cell = np.nonzero(near)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(best >= core_from), visits], names=["id", "h", "n", "v", "home", "core", "visits"])

    return classes.select("id", "h", "n", "v").mapInArrow(run, f"id long, h long, n long, v {kind}, home int, core boolean, visits array<int>")


def roots(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Smallest rank in the component of each node under the links (a[i], b[i])."""
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        if np.array_equal(after, label):
            return label
        label = after


def linked(left: pa.Table, right: pa.Table, cell: int, width: int, threshold: float) -> pa.Table:
    """(id, h, links, root_id, root_h) of the rows of two blocks that have a link between the blocks."""
    names = ["id", "h", "links", "root_id", "root_h"]
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    li, lh, ln, home = (left[c].to_numpy() for c in ("id", "h", "n", "home"))
    ri, rh, rn = (right[c].to_numpy() for c in ("id", "h", "n"))
    core = right["core"].to_numpy()
    hit = matrix(left["v"], width) @ matrix(right["v"], width).T >= threshold
    a, b = np.nonzero(hit)
    visitor = home[a] != cell
    before = (li[a] < ri[b]) | ((li[a] == ri[b]) & (lh[a] < rh[b]))
    both = {(i, int(c)) for i, cells in enumerate(right["visits"].to_pylist()) for c in cells or () if c < cell}  # these are found there
    elsewhere = np.fromiter(((j, c) in both for j, c in zip(b.tolist(), home[a].tolist())), bool, len(a)) if both else np.zeros(len(a), bool)
    ok = np.where(visitor, ~elsewhere, core[b] | before)
    a, b = a[ok], b[ok]
    ids, hs = np.concatenate((li, ri)), np.concatenate((lh, rh))
    links = np.bincount(a, rn[b], len(ids)) + np.bincount(b + len(li), ln[a], len(ids))
    order = np.lexsort((hs, ids))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = order[roots(a, b + len(li), rank)]
    at = np.flatnonzero(links)
    return pa.table(dict(zip(names, (pa.array(x) for x in (ids[at], hs[at], links[at].astype(np.int64), ids[root[at]], hs[root[at]])))))


def _links(placed: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """(id, h, links, root_id, root_h) from all cells; a row for each block that a class has links in, and one for its core."""
    stay = placed.select(F.col("home").alias("cell"), F.lit(1).alias("right"), (~F.col("core")).cast("int").alias("left"), F.when(F.col("core"), F.struct("id", "h")).alias("first"), F.when(F.col("core"), F.col("n")).alias("inside"))
    come = placed.select(F.explode("visits").alias("cell"), F.lit(0).alias("right"), F.lit(1).alias("left"), F.lit(None).cast("struct<id: bigint, h: bigint>").alias("first"), F.lit(None).cast("bigint").alias("inside"))
    cells = stay.unionByName(come).groupBy("cell").agg(F.sum("left").alias("lefts"), F.sum("right").alias("rights"), F.min("first").alias("first"), F.sum("inside").alias("inside"))
    cells = F.broadcast(cells.select("cell", F.ceil(F.col("lefts") / block).alias("na"), F.ceil(F.col("rights") / block).alias("nb"), "first", "inside"))  # a row for each centre, CENTRES at most
    go = placed.withColumn("cell", F.explode(F.concat("visits", F.when(F.col("core"), F.array().cast("array<int>")).otherwise(F.array("home"))))).join(cells, "cell").where("nb > 0")
    left = go.select("cell", F.pmod(F.xxhash64("id", "h"), "na").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), "id", "h", "n", "v", "home")
    host = placed.withColumn("cell", F.col("home")).join(cells, "cell")
    right = host.where("na > 0").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)).alias("a"), F.pmod(F.xxhash64("id", "h"), "nb").alias("b"), *(F.col(c).alias(c) for c in ("id", "h", "n", "v", "core", "visits")))

    def compare(key: tuple, l: pa.Table, r: pa.Table) -> pa.Table:
        return linked(l, r, int(key[0].as_py()), width, threshold)

    found = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(compare, "id long, h long, links long, root_id long, root_h long")
    inner = host.where("core").select("id", "h", (F.col("inside") - F.col("n")).alias("links"), F.col("first.id").alias("root_id"), F.col("first.h").alias("root_h"))
    return found.unionByName(inner)


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = CELL, block: int = BLOCK, seed: int = 0
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable, and ``kept`` marks the row that has
    it as its id. Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. Shorter
    vectors count as padded with 0. Rows that repeat an id are rows of their own (and all kept, if any of them is); rows with a null id
    link with nothing and have a null component and kept = false. An empty table gives no row. Other columns are ignored.

    Centres are fitted on a sample (``PER_CENTRE`` classes for each, so 131,072 at most); every class is assigned.
    """
    x = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, F.transform(x, lambda v: v + F.lit(0).cast(vectors.schema[vec_col].dataType.elementType))).alias("v"))
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(seed), "v"))
    known = rows.where("v is not null")
    n, width = known.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    k = max(1, min(CENTRES, n // cell))
    bound = max(k * PER_CENTRE, 4 * cell)
    sample = known.where(F.pmod("g", F.lit(max(1, n // bound))) == 0).dropDuplicates(["h"]).orderBy("g").limit(bound).select("v").toArrow()
    centres = spherical_kmeans(matrix(sample["v"], width), k, seed=seed) if sample.num_rows else np.eye(1, width)

    classes = known.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("h").alias("h"), F.first("g").alias("g"))
    keys = F.struct("id", "h")
    placed = materialize(_assigned(classes, centres, width, threshold, reach))
    pairs = materialize(_links(placed, width, threshold, block))
    components = connected_components(pairs.select(keys.alias("a"), F.struct(F.col("root_id").alias("id"), F.col("root_h").alias("h")).alias("b")))
    found = pairs.groupBy("id", "h").agg(F.sum("links").alias("links"))
    label = components.select(F.col("node.id").alias("id"), F.col("node.h").alias("h"), F.col("label.id").alias("component_id"))
    each = placed.select("id", "h", "n", F.xxhash64(F.lit(seed), "v").alias("g")).join(found, ["id", "h"], "left").join(label, ["id", "h"], "left")
    each = each.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h")).alias("h"), "g").join(each, ["h", "g"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
