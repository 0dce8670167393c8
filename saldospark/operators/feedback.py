"""Review decisions, propagation between documents, and the dictionary's upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.functions.plan import cut, lookup_side, small
from saldospark.schemas import EXCLUDED

LABELS = {"new": "➕ NUEVA CATEGORÍA", "skip": "🚫 NO INCLUIR"}


def _apply(df: DataFrame, changes: dict[str, Column], when: Column) -> DataFrame:
    return df.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in changes.items()})


def apply_corrections(df: DataFrame, corrections: DataFrame, mode: str = "batch") -> DataFrame:
    """Set the codes that reviewers chose: corrections(doc_id, linea, codigo_nuevo), one per row.

    The label for "don't include" becomes the exclusion mark, the one for a new category changes nothing. In mode
    "batch" the method and full confidence are set too; "single" keeps both. ``corrections`` are counted, up to a bound, and then joined.
    """
    chosen = F.when(F.col("codigo_nuevo") == LABELS["skip"], F.lit(EXCLUDED)).when(F.col("codigo_nuevo") != LABELS["new"], F.col("codigo_nuevo"))
    fixes = corrections.select("doc_id", "linea", chosen.alias("_new")).where("_new is not null and _new <> ''")
    changes = {"codigo_clasificado": F.col("_new"), "requiere_revision": F.lit(False)}
    if mode == "batch":
        changes |= {"metodo": F.lit("validacion_humana_lote"), "confianza": F.lit(1.0)}
    return _apply(df.join(lookup_side(fixes), ["doc_id", "linea"], "left"), changes, F.col("_new").isNotNull()).drop("_new")


def _looked_up(df: DataFrame, asking: Column, name: Column, table: DataFrame) -> DataFrame:
    """``df`` with the columns of ``table`` (_norm, ...) where a row asks for its normalised name and the table has it, else nulls.

    A small table is broadcast. For a large one only the asking rows are shuffled: the others would all have one key, null, and meet
    in one task. ``df`` is then read twice.
    """
    if small(table):
        return df.withColumn("_k", F.when(asking, T.normalize_name(name))).join(F.broadcast(table), F.col("_k") == F.col("_norm"), "left").drop("_k", "_norm")
    asks = F.coalesce(asking, F.lit(False))
    found = df.where(asks).withColumn("_k", T.normalize_name(name)).join(lookup_side(table), F.col("_k") == F.col("_norm"), "left").drop("_k", "_norm")
    return found.unionByName(df.where(~asks), allowMissingColumns=True)


def propagate_corrections(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Spread corrections(nombre_original, codigo_nuevo, seq) to open rows of the same normalised name in every document.

    Open: in review, without a code, or below full confidence. The last correction of a name wins. Only open rows look for a
    correction, among the names corrected (broadcast if they are few, which a bounded count tells; else ``df`` is read twice).
    """
    last = corrections.groupBy(T.normalize_name(F.col("nombre_original")).alias("_norm")).agg(F.max_by("codigo_nuevo", "seq").alias("_new"))
    open_ = F.col("requiere_revision") | (F.col("codigo_clasificado") == "") | (F.col("confianza") < 1.0)
    joined = _looked_up(df, open_, F.coalesce(F.col("nombre_original"), F.lit("")), last)
    changes = {"codigo_clasificado": F.col("_new"), "metodo": F.lit("validacion_humana_lote_propagada"), "confianza": F.lit(1.0), "requiere_revision": F.lit(False)}
    return _apply(joined, changes, F.col("_new").isNotNull()).drop("_new")


def first_labels(df: DataFrame, order: tuple[str, ...] = ("doc_id", "linea")) -> DataFrame:
    """(_norm, _first): the first code of each normalised name, in document and line order.

    An aggregate in two steps: by the name as written (combined before the shuffle), then by the normalised one, so that a name
    with a large share of all rows is neither sorted in one task nor normalised row by row.
    """
    raw = F.coalesce(F.col("nombre_original"), F.lit(""))
    usable = (F.col("codigo_clasificado") != "") & (F.col("codigo_clasificado") != EXCLUDED) & (raw != "")
    written = df.where(usable).groupBy(raw.alias("_raw")).agg(F.min(F.struct(*order, "codigo_clasificado")).alias("_at"))
    return written.groupBy(T.normalize_name(F.col("_raw")).alias("_norm")).agg(F.min("_at")["codigo_clasificado"].alias("_first"))


def propagate_labels(df: DataFrame, order: tuple[str, ...] = ("doc_id", "linea")) -> DataFrame:
    """Rows without a code take the first code of the same normalised name, in document and line order.

    ``df`` is read twice, for first labels and for rows: hand over a stored table or one that is cut. Only open
    rows look for a label; the labels are broadcast if a bounded count says that they are few, and else the open rows alone are
    shuffled to them (``df`` is read a third time for the rest).
    """
    raw = F.coalesce(F.col("nombre_original"), F.lit(""))
    joined = _looked_up(df, (F.col("codigo_clasificado") == "") & (raw != ""), raw, cut(first_labels(df, order)))
    changes = {"codigo_clasificado": F.col("_first"), "metodo": F.lit("propagado_automático"), "confianza": F.lit(1.0), "requiere_revision": F.lit(False)}
    return _apply(joined, changes, F.col("_first").isNotNull()).drop("_first")


def code_options(catalog: DataFrame) -> DataFrame:
    """(orden, opcion): what a reviewer can choose: nothing, each code in order, a new category, leaving the row out."""
    codes = catalog.select(F.lit(1).alias("grupo"), F.col("codigo_estandar").alias("opcion")).distinct()
    ends = catalog.sparkSession.createDataFrame([(0, ""), (2, LABELS["new"]), (3, LABELS["skip"])], "grupo int, opcion string")
    place = F.row_number().over(Window.orderBy("grupo", "opcion")) - 1  # the catalog has a fixed, small size
    return codes.unionByName(ends).select(place.alias("orden"), "opcion").orderBy("orden")


def select_rows(selection: DataFrame, add: DataFrame | None = None, discard: DataFrame | None = None) -> DataFrame:
    """A selection (doc_id, linea) with rows added and others taken out; each row once."""
    keys = ["doc_id", "linea"]
    out = selection.select(*keys) if add is None else selection.select(*keys).unionByName(add.select(*keys))
    return (out if discard is None else out.join(discard.select(*keys), keys, "left_anti")).distinct()


def upsert(table: DataFrame, rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """``table`` with ``rows`` added; of rows with one key the latest by ``seq`` stays."""
    both = table.unionByName(rows, allowMissingColumns=True)
    latest = F.max_by(F.struct(*both.columns), F.col(seq)).alias("r")
    return both.groupBy(F.col(key).alias("_key")).agg(latest).select("r.*")


def append_corrections(dictionary: DataFrame, corrections: DataFrame, source: str = "validacion_humana_lote") -> DataFrame:
    """The dictionary with an entry for each correction that names a code (exclusions stay out)."""
    rows = corrections.where(~F.col("codigo_nuevo").isin("", LABELS["skip"], LABELS["new"], EXCLUDED)).select(
        F.col("nombre_original").alias("cuenta_original"), F.col("codigo_nuevo").alias("codigo_estandar"), F.lit(source).alias("fuente"), "seq"
    )
    return dictionary.select("cuenta_original", "codigo_estandar", "fuente", "seq").unionByName(rows)


def search_dictionary(dictionary: DataFrame, catalog: DataFrame, query: str) -> DataFrame:
    """Entries whose name, standard name or code matches a case-insensitive pattern; an empty query returns all."""
    names = F.broadcast(catalog.select("codigo_estandar", "nombre_estandar"))
    joined = dictionary.join(names, "codigo_estandar", "left").withColumn("nombre_estandar", F.coalesce("nombre_estandar", F.lit("")))
    if query:
        hit = [F.coalesce(T.matches(F.col(c), query), F.lit(False)) for c in ("cuenta_original", "nombre_estandar", "codigo_estandar")]
        joined = joined.where(hit[0] | hit[1] | hit[2])
    return joined.select("cuenta_original", T.catalog_label(F.col("codigo_estandar"), F.col("nombre_estandar")).alias("codigo_y_nombre"), "fuente")


def missing_references(rows: DataFrame, catalog: DataFrame, code: str = "codigo_estandar") -> DataFrame:
    """Rows whose code isn't in the catalog (foreign-key check)."""
    known = F.broadcast(catalog.select(F.col("codigo_estandar").alias("_k")))
    return rows.join(known, rows[code] == F.col("_k"), "left_anti")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, veces) of keys that stand more than once (uniqueness check)."""
    return rows.groupBy(key).agg(F.count("*").alias("veces")).where("veces > 1")


def keep_documents(df: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the documents that are still there."""
    return df.join(documents.select("doc_id"), "doc_id", "left_semi")


def drop_documents(df: DataFrame, documents: DataFrame) -> DataFrame:
    return df.join(documents.select("doc_id"), "doc_id", "left_anti")
