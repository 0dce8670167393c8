"""Helpers shared by the corpus operators: checkpoints, Arrow slices and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (local tests) it is a temporary
    folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="saldospark-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids give null)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string")), F.lit(folds))


def text_slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that a slice holds about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // max_bytes
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(a), int(b - a))


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the offsets (len + 1) where each begins."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, np.concatenate(([0], np.cumsum(lens)))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i+1]]`` along axis 0 for every i; empty segments give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node with an edge; the label is the smallest node that it reaches.

    Every round gives a node the smallest label among its neighbours and then follows that label once
    (pointer jumping), so long chains take a logarithmic number of rounds in practice. All state stays in
    distributed tables; only "did a label change" reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        hop = materialize(
            near.withColumn("old", F.lit(None).cast(labels.schema["label"].dataType))
            .unionByName(labels.withColumn("old", F.col("label")))
            .groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        )
        jump = hop.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(hop.join(jump, "label").select("node", F.col("next").alias("label"), "old"))
        done = is_empty(after.where("label <> old"))
        labels = after.select("node", "label")
        if done:
            return labels
