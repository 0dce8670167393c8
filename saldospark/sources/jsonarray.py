"""A JSON array of objects as a splittable scan.

The text reader cuts files at every ``}``, in splits of any size, so an array on one line needs no single task. Where an
element ends depends on the state before a piece: inside a string or not, and how deep. Both are associative. A piece
flips the string state by the parity of its quotes, and adds to the depth what its brackets outside of strings come to, which is worked out for
both states a split can begin in. The sums of the splits, a row each, are added up along the file; then every piece
knows its state, and the ends of elements are numbered in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "}"




def _before(value: Column | str, split: bool) -> Column:
    """The sum over what stands before: pieces of the same split, or splits of the same file."""
    keys, order = (("archivo", "tramo"), "pieza") if split else (("archivo",), "tramo")
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(over), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _joined(pieces: DataFrame, splits: DataFrame, *columns: str) -> DataFrame:
    known = splits.select(F.col("archivo").alias("_f"), F.col("tramo").alias("_t"), *columns)
    return pieces.join(known, (F.col("archivo") == F.col("_f")) & (F.col("tramo") == F.col("_t"))).drop("_f", "_t")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, lugar, texto): the elements of the files' JSON arrays, numbered from 0 in their order in the file.

    Elements are objects. An empty array or file gives no row, nor does an element without an end. The size of a split is
    that of the session (``spark.sql.files.maxPartitionBytes``); an element may lie over several splits.
    """
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", END).text(path).select(
        meta["file_path"].alias("archivo"), meta["file_block_start"].alias("tramo"), F.monotonically_increasing_id().alias("pieza"), "value",
        F.regexp_replace("value", r"\\.|\\$", "").alias("_bare"),  # escaped characters are no quotes
    )
    pieces = pieces.withColumn("_q", _count(F.col("_bare"), '"').cast("long")).withColumn("_own", _before("_q", split=True))

    def depth(begins_inside: int) -> Column:
        """What a piece and the ``}`` behind it add to the depth, if its split begins inside a string or not."""
        inside = (F.col("_own") + begins_inside) % 2 == 1
        seen = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), "_bare"), r'"[^"]*("|$)', "")
        return (_count(seen, "[{") - _count(seen, "]}") - F.when((F.col("_own") + F.col("_q") + begins_inside) % 2 == 1, 0).otherwise(1)).cast("long")

    pieces = pieces.select("archivo", "tramo", "pieza", "value", "_q", "_own", depth(0).alias("_d0"), depth(1).alias("_d1"))
    splits = pieces.groupBy("archivo", "tramo").agg(F.sum("_q").alias("_q"), F.sum("_d0").alias("_d0"), F.sum("_d1").alias("_d1"))
    splits = splits.withColumn("_inside", _before("_q", split=False) % 2)
    splits = splits.withColumn("_deep", _before(F.when(F.col("_inside") == 1, F.col("_d1")).otherwise(F.col("_d0")), split=False))
    df = _joined(pieces, splits, "_inside", "_deep")
    df = df.withColumn("_d", F.when(F.col("_inside") == 1, F.col("_d1")).otherwise(F.col("_d0")))
    closed = (F.col("_own") + F.col("_q") + F.col("_inside")) % 2 == 0
    after = F.col("_deep") + _before("_d", split=True) + F.col("_d")
    df = df.withColumn("_ends", closed & (after == 1)).select("archivo", "tramo", "pieza", "value", "_ends")

    ended = F.col("_ends").cast("long")
    totals = df.groupBy("archivo", "tramo").agg(F.sum(ended).alias("_n")).withColumn("_first", _before("_n", split=False))
    df = _joined(df.withColumn("_nth", _before(ended, split=True)), totals, "_first").withColumn("lugar", F.col("_first") + F.col("_nth"))
    parts = F.array_sort(F.collect_list(F.struct("tramo", "pieza", "value")))
    whole = df.groupBy("archivo", "lugar").agg(F.bool_or("_ends").alias("_whole"), parts.alias("_parts")).where("_whole")
    text = F.concat(F.array_join(F.transform("_parts", lambda p: p["value"]), END), F.lit(END))
    return whole.select("archivo", "lugar", F.regexp_replace(text, r"^[\s\x{FEFF}]*[\[,]\s*", "").alias("texto"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(archivo, lugar, r): the elements with ``schema``; one that doesn't fit is a struct of nulls."""
    return array_elements(spark, path).select("archivo", "lugar", F.from_json("texto", schema).alias("r"))
