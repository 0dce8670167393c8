"""Propagation of labels over documents as they arrive.

A stateful operator keyed by normalised name (and salt) keeps the first label of the name, in document and line order, and the rows
that have no code of their own. A row goes out as it arrives; open rows go out again whenever an earlier label turns
up, so the latest version of each row is what ``feedback.propagate_labels`` gives over all rows so far, however they
were divided into micro-batches and in whatever order they came.

A frequent name doesn't meet one task: its open rows are dealt over ``SALTS`` keys, and each of these gets the labels of the name, of which a
partial aggregate within each task's input leaves one per name and micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saldospark.functions import text as T
from saldospark.schemas import EXCLUDED
from saldospark.streaming.ingest import refuse_new_checkpoint

SALTS = 8
ROW = "doc_id string, linea int, nombre_original string, codigo_clasificado string, metodo string, confianza double, requiere_revision boolean"
OUT = f"{ROW}, version long"
_KEYED = f"norm string, sal int, etiqueta boolean, {ROW}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstLabel(StatefulProcessor):
    """State of a key: the first label (document, line, code), and its open rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.label = handle.getValueState("primera", "doc_id string, linea int, codigo string")
        self.open = handle.getMapState("abiertas", "doc_id string, linea int", ROW.split(", ", 2)[2])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.label.get() if self.label.exists() else None
        before, arrived = first, []
        for b in rows:
            labels = b[b["etiqueta"]]
            for doc, line, code in zip(labels["doc_id"], labels["linea"], labels["codigo_clasificado"]):
                if first is None or (doc, line) < first[:2]:
                    first = (doc, int(line), code)
            for r in b[~b["etiqueta"]].itertuples(index=False):
                values = (r.nombre_original, r.codigo_clasificado, r.metodo, float(r.confianza), bool(r.requiere_revision))
                self.open.updateValue((r.doc_id, int(r.linea)), values)
                arrived.append((r.doc_id, int(r.linea), *values))
        out = arrived
        if first != before:
            self.label.update(first)
            out = [(*k, *v) for k, v in self.open.iterator()]
        if out:
            df = pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])
            if first is not None:
                df = df.assign(codigo_clasificado=first[2], metodo="propagado_automático", confianza=1.0, requiere_revision=False)
            yield df

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, salts: int) -> DataFrame:
    """Open rows under one salt each, and of the labels in each piece of a task's input the first of every name, under all salts."""
    raw = F.coalesce("nombre_original", F.lit(""))
    named = rows.withColumn("norm", T.normalize_name(raw)).where(raw != "").where(F.col("codigo_clasificado") != EXCLUDED)
    labels = F.col("codigo_clasificado") != ""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            label = b["codigo_clasificado"] != ""
            yield pd.concat([b[~label], b[label].sort_values(["doc_id", "linea"]).drop_duplicates("norm")])

    few = named.select("norm", *[c.split()[0] for c in ROW.split(", ")]).mapInPandas(combine, f"norm string, {ROW}")
    salt = F.pmod(F.xxhash64("doc_id", "linea"), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return few.select("norm", F.explode(F.when(labels, every).otherwise(F.array(salt))).alias("sal"), labels.alias("etiqueta"), *[c.split()[0] for c in ROW.split(", ")])


def propagate(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """A stream of result rows (``ROW``) to a stream of open rows as they stand: a row comes again when its label changes.

    Rows with a code, with the exclusion mark or without a name don't change and aren't in this stream; ``run`` writes both. The session needs
    the RocksDB state store (``PROVIDER``).
    """
    return _keyed(rows, salts).groupBy("norm", "sal").transformWithStateInPandas(FirstLabel(), ROW, "Update", "None")


def run(rows: DataFrame, out: str, checkpoint: str, salts: int = SALTS, **trigger):
    """Write every version of every row to ``out`` (Parquet, one folder for each batch number, which a repeated batch replaces)."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    refuse_new_checkpoint(spark, out, checkpoint)

    def write(kind: str):
        def save(df: DataFrame, batch: int) -> None:
            df.withColumn("version", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/{kind}/lote={batch}")
        return save

    closed = rows.where((F.col("codigo_clasificado") != "") | (F.coalesce("nombre_original", F.lit("")) == ""))
    queries = [(closed, "cerradas", "append"), (propagate(rows, salts), "abiertas", "update")]
    return [df.writeStream.outputMode(mode).foreachBatch(write(kind)).option("checkpointLocation", f"{checkpoint}/{kind}").trigger(**(trigger or {"availableNow": True})).start()
            for df, kind, mode in queries]


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The current version of each row that ``run`` has written."""
    rows = spark.read.schema(OUT).parquet(f"{out}/cerradas/*", f"{out}/abiertas/*")
    last = F.row_number().over(Window.partitionBy("doc_id", "linea").orderBy(F.desc("version")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "version")
