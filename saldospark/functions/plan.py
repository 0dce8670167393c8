"""Help for the shape of plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def fence(df: DataFrame) -> DataFrame:
    """The same rows, with every column worked out once.

    Filters and projections above would otherwise be merged into the expressions below, again and again for
    each use of a column; a generator is where the optimizer stops doing so.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one of the driver only where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="saldospark-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder, for tables that are read more than once.

    Spark removes it with the table if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def spread(df: DataFrame, rows: int, each: int = 2_000) -> DataFrame:
    """A small table of ``rows`` rows, each of which is much work, dealt over the cores; a large one as it is."""
    parts = min(df.sparkSession.sparkContext.defaultParallelism, rows // each)
    return df.repartition(parts) if 1 < parts and rows <= BROADCAST_ROWS else df


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a bounded count says that it is small. A table cut before is counted at no cost."""
    return F.broadcast(df) if small(df) else df


def lookup_side(df: DataFrame) -> DataFrame:
    """``df`` as the table that a larger one looks rows up in: broadcast if a bounded count says that it is small, else hashed in its
    shuffled parts, so that the larger side isn't sorted and a frequent key takes time but no memory."""
    return F.broadcast(df) if small(df) else df.hint("shuffle_hash")
