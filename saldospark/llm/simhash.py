"""SimHash near-duplicates: fingerprints, segment-popcount grid join, components.

A fingerprint has 64 bits over word shingles. Two fingerprints link at ``RADIUS`` (two) or fewer differing bits.

Search: a fingerprint is embedded as 32 popcounts of two-bit segments. Manhattan distance between two
embeddings is a lower bound of the Hamming distance, so links are found by a range join in the embedding, on grids that
get finer:

1. A coarse grid: segments form five groups, and a point lies in one cell for each choice of three groups. Two points
   within Manhattan distance 2 differ in at most two groups, so they share a cell; a point alone in its ten cells
   has no link.
2. A fine grid: a cell is one popcount vector. A point goes to its own cell and to those at distance 1. Two points within
   Manhattan distance 2 meet in a cell; what goes on is the points with the cells in which they met another.
3. Cells are split by the exact bits: of a cell, a point takes the places that are its own fingerprint or differ from it in one bit (one
   in its own cell, one or two in each of the others). Points of a cell that are within two bits meet at a place, and
   few do: a place has 65 points at most, however crowded its cell is.
4. Verification: points that met at a place are paired with the smallest of them, and the pair stands if they differ in at most two
   bits. Those pairs give the components of all links.

Every step is linear in the points, and nothing depends on how crowded a cell is.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import prefix_hash, span_hash
from .common import connected_components, is_empty, materialize, text_slices

SEED = 42
RADIUS = 2
LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``width`` words; fewer words give one shingle, none gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits on ASCII white space
    if not words:
        return []
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    hashed, seed = xxhash.xxh64_intdigest, SEED
    return [hashed(joined[a : b - 1], seed) for a, b in zip(starts, starts[width:])]


def simhash(texts: list[str | None], width: int = 3) -> np.ndarray:
    """Fingerprints as uint64; a bit is 1 if it is set in over half of the hashes."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width), dtype=np.uint64)
        n, count = len(hashes), np.zeros(64, dtype=np.int64)
        for a in range(0, n, 1 << 15):
            count += np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        if n:
            out[i] = np.packbits(count * 2 > n).view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long), a row for each row of ``docs``. Null text counts as empty; an empty text has fingerprint 0."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches, "text"):
            fp = simhash(b.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, fp long")


def _long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def popcounts(fp):
    """The 32 popcounts of two-bit segments, packed in two bits each."""
    one, two = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return one.bitwiseXOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))


def cell_masks(radius: int = RADIUS, same: int = 3) -> list[int]:
    """A mask of packed fields for each choice of ``same`` of ``radius + same`` interleaved groups of segments."""
    groups = radius + same
    masks = [sum(3 << (2 * s) for s in range(32) if s % groups == g) for g in range(groups)]
    return [_long(reduce(int.__or__, c)) for c in combinations(masks, same)]


def coarse_cells(pc: Column) -> Column:
    """The ten cells of a packed popcount vector in the coarse grid."""
    return F.array(*[F.struct(F.lit(i).alias("choice"), pc.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks())])


def fine_cells(pc: Column, fp: Column) -> Column:
    """(cell, places) of the packed popcount vectors within Manhattan distance 1, with the fingerprints there that differ from ``fp`` in at most one bit.

    In every segment the count goes one up (below 2) or one down (above 0), by its lower or its upper bit.
    """
    def struct(cell: Column, *places: Column) -> Column:
        return F.struct(cell.alias("cell"), F.array(*places).alias("places"))

    near = [struct(pc, fp)]
    for s in range(32):
        count = F.shiftrightunsigned(pc, 2 * s).bitwiseAND(F.lit(3).cast("long"))
        one, two = (pc.bitwiseXOR(F.lit(_long(bits << 2 * s))) for bits in (1, 3))  # 0 and 1, 1 and 2 change places
        low, high = (fp.bitwiseXOR(F.lit(_long(1 << (2 * s + k)))) for k in (0, 1))
        lower_set = F.shiftrightunsigned(fp, 2 * s).bitwiseAND(F.lit(1).cast("long")) == 1
        fall, rise = F.when(lower_set, low).otherwise(high), F.when(lower_set, high).otherwise(low)
        near += [F.when(count == 0, struct(one, low, high)).when(count == 1, struct(two, rise)), F.when(count == 2, struct(two, low, high)).when(count == 1, struct(one, fall))]
    return F.array_compact(F.array(*near))


def meeting(dealt: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of the rows (fp, cell, ...) whose cell holds another point too."""
    crowd = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    return dealt.join(crowd, "cell").select(*keep)


def links(points: DataFrame) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints in ``points(fp)``, with the components of "differ by two bits or fewer"."""
    pc = popcounts(F.col("fp"))
    coarse = materialize(meeting(points.select("fp", F.explode(coarse_cells(pc)).alias("cell")), "fp").distinct())
    fine = coarse.select("fp", F.inline(fine_cells(pc, F.col("fp"))))
    places = meeting(fine, "fp", F.explode("places").alias("place"))
    met = places.groupBy("place").agg(F.collect_list("fp").alias("met")).where(F.size("met") > 1)
    pairs = met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of two bits or fewer, itself included. Null and
    empty texts have fingerprint 0 and link like any other. Null ids are passed over when the smallest is
    taken (null only if the whole group has none). Repeated rows are kept.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = connected_components(links(points))
    named = materialize(labels.join(points, labels.node == points.fp).select("fp", "label", "first_id"))
    least = materialize(named.groupBy("label").agg(F.min("first_id").alias("component_id")))
    joined = named.join(least, "label").select(F.col("fp").alias("linked"), "component_id")
    of_print = materialize(
        points.join(joined, points.fp == joined.linked, "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


# --- one document of each group, at a similarity of five-word shingles -------------------------------------------

WIDTH = 5
FREQUENT, SLICE_BYTES = 1 << 18, 8 << 20
BROADCAST_IDS = 1_000_000  # ids up to which a set of documents is broadcast (8 MB); larger sets are shuffled
#: Partners of one document that are compared in one run of rows; members up to which a group's pairs are rows (at most
#: half as many a member); members and shingles of a block of a larger group.
PART, GROUP, BLOCK_DOCS, BLOCK_SHINGLES = 64, 64, 500, 100_000


def without(docs: DataFrame, ids: DataFrame, id_col: str, keep: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids(doc_id)``, or with ``keep`` those whose id is."""
    ids = ids.select(F.col("doc_id").alias(id_col))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, id_col, "left_semi" if keep else "left_anti")


def shingle_array(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; a shorter text is one shingle, also an empty one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    width = min(width, len(words))
    return np.unique(span_hash(prefix_hash(np.frombuffer(b" ".join(words), np.uint8)), start[: len(words) - width + 1], stop[width - 1 :]))


def frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in many documents, sorted, and their counts; at most ``FREQUENT``. Counted are repeats within
    slices of the text. The counts only order the shingles, so a shingle missed costs time and no pair."""

    def count(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        many = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many])], names=["token", "n"])

    def run(batches):
        sets, size = [], 0
        for b in text_slices(batches, "text"):
            sets += [shingle_array(t) for t in b.column(0).to_pylist()]
            size += b.nbytes
            if size >= SLICE_BYTES:
                yield count(sets)
                sets, size = [], 0
        if sets:
            yield count(sets)

    counts = materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    power = F.floor(F.log2("n")).cast("int")
    total, least = 0, 64
    for k, n in sorted(map(tuple, counts.groupBy(power.alias("k")).count().collect()), reverse=True):
        total += n
        if total > FREQUENT:
            break
        least = k
    rows = counts.where(power >= least).toPandas().sort_values("token") if total else None
    if rows is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    token, n = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def prefix_of(tokens: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 + floor(n / 20) of n sorted shingles, by count and hash.

    Sets of n and m shingles with a similarity of 0.8 have c >= 0.8 max(n, m) in common. The k-th common one in any common
    order stands at place k + n - c or before in the first set, k + m - c or before in the second. So such prefixes have
    1 + min(n, m) // 20 >= 1 + n // 25 shingles in common at least, whatever the counts are.
    """
    n = len(tokens)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        tokens = tokens[np.argsort(np.where(known[at] == tokens, counts[at], 0), kind="stable")]
    return tokens[: n - (4 * n + 4) // 5 + 1 + n // 20]


def prefixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, token): the prefix of each document, and its number of distinct shingles."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col))

    def run(batches):
        for b in text_slices(batches, "text"):
            sets = [shingle_array(t) for t in b.column(1).to_pylist()]
            found = [prefix_of(s, *shipped.value) for s in sets]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            n = np.array([len(s) for s in sets], np.int32)[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(n), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "n", "token"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n int, token long")


def rare_shared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, doc_id, n): shingles by which similar documents meet.

    Of a document's prefix count those shingles that stand in another prefix too; a document with fewer than 1 + n // 25
    of them has no similar one. Similar documents have so many of them in common, so they still share one if each drops
    its n // 25 most frequent. Documents that share a passage and little else fall out here.
    """
    all_ = prefixes(docs, id_col, text_col)  # worked out twice: a checkpoint of it would be larger than the text
    often = all_.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("doc_id")
    ranked = all_.join(often, "token").select("*", F.count("*").over(own).alias("s"), F.row_number().over(own.orderBy("df", "token")).alias("k"))
    least = F.floor(F.col("n") / 25)
    return materialize(ranked.where((F.col("s") > least) & (F.col("k") <= F.col("s") - least)).select("token", "doc_id", "n"))


def fingerprint_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b), a < b: documents whose fingerprints are linked, by the smallest of each, and documents of one fingerprint."""
    prints = materialize(fingerprints(docs, id_col, text_col))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    p, q = (points.select(F.col("fp").alias(x), F.col("first_id").alias(f"id_{x}")) for x in "ab")
    linked = links(points).join(p, "a").join(q, "b").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    same = prints.join(points, "fp").where("doc_id <> first_id").select(F.col("first_id").alias("x"), F.col("doc_id").alias("y"))
    return linked.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_edges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of similar documents, with the same components as all pairs of similarity 0.8 or more.

    Any such pair shares a shingle of ``rare_shared``. First a document is compared with the smallest and the largest that
    hold one of its shingles, and over fingerprint links: linear, and it joins most groups. Then all documents that
    share a shingle and aren't yet in one component are compared, none left out: pair by pair where few hold
    the shingle, else in blocks, so that no rows of pairs are made of a large group.
    """
    rows = rare_shared(docs, id_col, text_col)
    ends = rows.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    met = rows.join(ends, "token").select("doc_id", F.explode(F.array("lo", "hi")).alias("r")).where("doc_id <> r")
    star = met.select(F.least("doc_id", "r").alias("a"), F.greatest("doc_id", "r").alias("b"))
    first = materialize(star.unionByName(fingerprint_pairs(docs, id_col, text_col)).distinct())
    edges = materialize(similar_pairs(docs, first, id_col, text_col))
    labels = connected_components(edges)
    named = materialize(rows.join(labels, rows.doc_id == labels.node, "left").select("token", "doc_id", "n", F.coalesce("label", "doc_id").alias("label")))
    groups = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    open_ = materialize(named.join(groups.where("x <> y").select("token", "docs", "shingles"), "token"))
    left = open_.where(F.col("docs") <= GROUP)
    right = left.select("token", *[F.col(c).alias(f"{c}2") for c in ("doc_id", "n", "label")])
    fit = 5 * F.least("n", "n2") >= 4 * F.greatest("n", "n2")
    meet = left.join(right, "token").where((F.col("doc_id") < F.col("doc_id2")) & (F.col("label") != F.col("label2")) & fit)
    rest = materialize(meet.select(F.col("doc_id").alias("a"), F.col("doc_id2").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    return edges.unionByName(similar_pairs(docs, rest, id_col, text_col)).unionByName(similar_in_blocks(docs, open_.where(F.col("docs") > GROUP), id_col, text_col))


def similar(both, n, m):
    """Whether sets of n and m members with ``both`` in common have a similarity of 0.8 or more."""
    return 9 * both >= 4 * (n + m)


def similar_pairs(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more, worked out exactly.

    A pair's centre is the document that stands in more pairs. A centre's text is sent once for each ``PART`` of its
    partners, in front of theirs, so texts aren't paired in rows, and a centre of many is split.
    """
    degree = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("k")))
    known = pairs.join(degree.select(F.col("doc_id").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("doc_id").alias("b"), F.col("k").alias("kb")), "b")
    flip = F.col("kb") > F.col("ka")
    dealt = materialize(known.select(
        F.when(flip, F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("partner"), F.ceil(F.greatest("ka", "kb") / PART).alias("parts")
    ).select("centre", "partner", F.pmod(F.xxhash64("partner"), F.col("parts")).alias("part")))
    texts = without(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), degree, "doc_id", keep=True)
    leads = dealt.select("centre", "part").distinct().join(texts, F.col("centre") == F.col("doc_id")).select("centre", "part", F.lit(None).cast(docs.schema[id_col].dataType).alias("partner"), "text")
    others = dealt.join(texts, F.col("partner") == F.col("doc_id")).select("centre", "part", "partner", "text")
    id_type = docs.schema[id_col].dataType.simpleString()

    def check(batches):
        own = np.zeros(0, np.uint64)
        for b in text_slices(batches, "text"):
            keep = []
            for partner, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                tokens = shingle_array(text)
                if partner is None:
                    own = tokens
                keep.append(partner is not None and similar(len(np.intersect1d(own, tokens, assume_unique=True)), len(own), len(tokens)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = leads.unionByName(others).repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("partner").asc_nulls_first())
    found = rows.mapInArrow(check, f"a {id_type}, b {id_type}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def block_links(sets: list[np.ndarray], label: list, block: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets of different labels, without those that close a circle. If there are two blocks, pairs within
    one are left to the call for that block."""
    n = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1  # shingles of one set only are in no intersection
    row, shared = np.repeat(np.arange(len(sets)), n), count[place] > 1
    row, column = row[shared], often[place[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(often[-1]) + 1, 4096):
        here = (column >= a) & (column < a + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[here], column[here] - a] = 1
        both += m @ m.T
    fine = similar(both.astype(np.int64), n[:, None], n[None, :])
    if len(set(block.tolist())) > 1:
        fine &= block[:, None] != block[None, :]
    root, out = {x: x for x in label}, []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in np.argwhere(np.triu(fine, 1)).tolist():
        x, y = find(label[i]), find(label[j])
        if x != y:
            root[y] = x
            out.append((i, j))
    return out


def similar_in_blocks(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Similar documents (a, b) of different labels within each group of ``groups(token, doc_id, label, docs, shingles)``.

    A group is dealt into blocks of a bounded number of documents and shingles, and every two blocks meet. Only links that
    join labels come out, fewer than a meeting's documents.
    """
    schema = docs.schema[id_col].dataType.simpleString()
    ids = materialize(groups.select("doc_id").distinct())
    texts = without(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ids, "doc_id", keep=True)

    def pack(batches):
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_array(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "tokens"])

    def compare(table: pa.Table) -> pa.Table:
        found = block_links([np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()], table["label"].to_pylist(), table["own"].to_numpy())
        i, j = zip(*found) if found else ((), ())
        return pa.table({"a": table["doc_id"].take(pa.array(i, pa.int64())), "b": table["doc_id"].take(pa.array(j, pa.int64()))})

    blocks = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = groups.select("token", "doc_id", "label", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sets = texts.mapInArrow(pack, f"doc_id {schema}, tokens binary")
    met = other.join(sets, "doc_id").groupBy("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    links_ = met.applyInArrow(compare, f"a {schema}, b {schema}")
    return links_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their group: the smallest id of each group of near-duplicates.

    Texts are near-duplicates if their sets of five-word shingles have a similarity of 0.8 or more (equal texts
    always are; null counts as empty). Prefixes of the sets propose pairs without loss, the similarity decides. Of rows that
    repeat an id one stays (smallest hash of the text). A row without an id goes if a document with an id has the
    same text; of several such rows with one text one stays. Columns are those of ``docs``.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.where(F.col(id_col).isNotNull())
    digest = materialize(named.select(F.col(id_col).alias("doc_id"), F.md5(whole.cast("binary")).alias("h")))
    firsts = materialize(digest.groupBy("h").agg(F.min("doc_id").alias("first_id")))
    copies = materialize(digest.join(firsts, "h").where("doc_id <> first_id").select("doc_id").distinct())
    twice = materialize(digest.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not is_empty(twice):
        again = named.join(twice.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
        order = [F.xxhash64(whole), F.to_json(F.struct("*"))]
        one = again.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where("__n = 1").drop("__n")
        named = without(named, twice, id_col).unionByName(one)
    single = without(named, copies, id_col)
    labels = connected_components(similar_edges(single, id_col, text_col))
    drop = materialize(copies.unionByName(labels.where("node <> label").select(F.col("node").alias("doc_id"))).distinct())
    kept = without(named, drop, id_col)
    bare = docs.where(F.col(id_col).isNull())
    if not is_empty(bare):
        key = F.md5(whole.cast("binary"))
        fresh = bare.withColumn("__h", key).join(firsts.select(F.col("h").alias("__h")), "__h", "left_anti")
        # equal rows of one text are the same row, so the smallest stands for all
        kept = kept.unionByName(fresh.groupBy("__h").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("__r")).select("__r.*"))
    return kept
