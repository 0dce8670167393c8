"""A total order over files: range partitions, sorted, in numbered files.

Files read by name, and rows as they stand, are in order. Places in the whole table are a row's place in its file and the number
of rows in the files before, so no task sorts or numbers the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files_for(df: DataFrame, rows: int = 500_000, least: int = 8) -> int:
    """The number of files in which each has about ``rows`` rows, however large ``df`` is; ``df`` is counted, so hand over a stored table."""
    return max(least, -(-df.count() // rows))


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column], files: int = 8, kind: str = "parquet", **options: str) -> None:
    """Write ``df`` in ``files`` files at most, the parts of a range partitioning by ``order``, each sorted by it."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").options(**options).format(kind).save(path)


def read_places(spark: SparkSession, path: str, name: str = "lugar") -> DataFrame:
    """The rows of a table written by ``write_ordered`` (Parquet), with their place from 1 on in the order of files and rows."""
    meta = F.col("_metadata")
    rows = spark.read.parquet(path).select("*", meta["file_name"].alias("_file"), meta["row_index"].alias("_row"))
    sizes = spark.read.parquet(path).select(meta["file_name"].alias("_of")).groupBy("_of").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return rows.join(F.broadcast(sizes.select("_of", before.alias("_before"))), F.col("_file") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_of", "_before")


def out_of_order(spark: SparkSession, path: str, keys: Sequence[Column]) -> DataFrame:
    """(archivo, fila) of rows whose key is below that of the row before, in the order of files and rows; empty if the order holds.

    Within a file neighbours are compared; between files the last row of one with the first of the next (a row for each file).
    """
    meta = F.col("_metadata")
    rows = spark.read.parquet(path).select(meta["file_name"].alias("archivo"), meta["row_index"].alias("fila"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"))
    inside = Window.partitionBy("archivo").orderBy("fila")
    bad = rows.withColumn("_p", F.lag("k").over(inside)).where("_p > k").select("archivo", "fila")
    ends = rows.groupBy("archivo").agg(F.min_by("k", "fila").alias("first"), F.max_by("k", "fila").alias("last"))
    between = ends.withColumn("_p", F.lag("last").over(Window.orderBy("archivo"))).where("_p > first").select("archivo", F.lit(0).cast("long").alias("fila"))
    return bad.unionByName(between)
