"""A merge sink: tables divided by a hash bucket of the key, of which a load rewrites only those it touches.

A load has two steps. First the new content of the touched buckets is written to a pending table, which is in the metastore only
once all of it is written. Then those buckets are replaced by dynamic partition overwrite, and the pending table is dropped. A load that dies in
the first step has changed nothing; one that dies in the second left the pending table, and the next load starts by
replacing the buckets from it again. So no row lives only in a place that is being replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
BUCKET = "cubo"


def bucket_of(key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(spark: SparkSession, table: str, columns: str) -> None:
    """An empty table with ``columns`` and the bucket, where it doesn't exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {BUCKET} int) USING parquet PARTITIONED BY ({BUCKET})")


def recover(spark: SparkSession, table: str) -> bool:
    """Finish a load that died while it replaced buckets; True if there was one."""
    pending = f"{table}__pendiente"
    if not spark.catalog.tableExists(pending):
        return False
    _replace(spark, table, pending)
    return True


def overwrite_buckets(rows: DataFrame, table: str) -> None:
    """Replace the buckets that ``rows`` has, and no others."""
    conf, mode = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"  # a writer's option doesn't reach catalog tables
    before = conf.get(mode)
    conf.set(mode, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        conf.set(mode, before)


def _replace(spark: SparkSession, table: str, pending: str) -> None:
    overwrite_buckets(spark.table(pending).select(*spark.table(table).columns), table)
    spark.sql(f"DROP TABLE {pending}")


def merge(rows: DataFrame, table: str, key: str, buckets: int = BUCKETS) -> None:
    """Put ``rows`` into ``table``: a row with a known key replaces the one that is there, others are added.

    ``rows`` has one row for each key and the table's columns but the bucket (a null key is a key). Numbers of buckets are a table's for life.
    Loading the same rows again leaves the same table. The numbers of the touched buckets (``buckets`` at most) pass through the
    driver, so that the table's other buckets are neither read nor written.
    """
    spark = rows.sparkSession
    recover(spark, table)
    columns = spark.table(table).columns
    new = rows.withColumn(BUCKET, bucket_of(key, buckets)).select(*columns)
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
    if not touched:
        return
    old = spark.table(table).where(F.col(BUCKET).isin(touched))
    kept = old.join(new.select(key), old[key].eqNullSafe(new[key]), "left_anti")
    pending = f"{table}__pendiente"
    kept.unionByName(new).repartition(len(touched), BUCKET).write.mode("overwrite").format("parquet").saveAsTable(pending)
    _replace(spark, table, pending)
