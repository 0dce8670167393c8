"""An extension: new text documents are parsed as they arrive, with the same pure transforms as in batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saldospark.operators.parse import parse_lines


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (doc_id, linea, texto), a document per file."""
    whole = spark.readStream.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return whole.select("doc_id", F.posexplode(F.split("value", r"\r?\n")).alias("linea", "texto"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under a path of any store."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").take(1))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def refuse_new_checkpoint(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Batch numbers are a checkpoint's own: a new checkpoint beside an old output would replace its first batches, so it raises."""
    if exists(spark, out) and not exists(spark, checkpoint):
        raise ValueError(f"{out} was written from another checkpoint than {checkpoint}: give that one, or a new output")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse every new file under ``path`` and append its accounts to ``out`` once (per micro-batch, all available files)."""
    refuse_new_checkpoint(spark, out, checkpoint)

    def write(batch: DataFrame, epoch: int) -> None:
        parse_lines(batch).withColumn("lote", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(out)

    return stream_lines(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
