"""Per-document profile: code format, thousands separator, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.schemas import FORMATS

FORMAT_LINES, AMOUNT_LINES = 60, 80
AMOUNT = r"(-?\(?[\d.,]{1,18}\)?)"


def detect_code_format(lines: DataFrame) -> DataFrame:
    """(doc_id, formato_codigo): the most frequent format of the first word of the first 60 lines; ties in fixed order."""
    word = F.element_at(F.split(T.strip(F.col("texto")), r"(?U)\s+"), 1)
    votes = lines.where(F.col("linea") < FORMAT_LINES).withColumn("_f", T.code_format(word))
    counts = votes.groupBy("doc_id").agg(*[F.count_if(F.col("_f") == f).alias(f) for f in FORMATS])
    best = F.greatest(*FORMATS)
    out = F.lit(FORMATS[-1])
    for f in reversed(FORMATS):
        out = F.when(F.col(f) == best, F.lit(f)).otherwise(out)
    return counts.select("doc_id", out.alias("formato_codigo"), *FORMATS)


def detect_thousands_separator(lines: DataFrame) -> DataFrame:
    """(doc_id, separador_miles, puntos, comas): votes of everything that looks like an amount in the first 80 lines."""
    tokens = lines.where(F.col("linea") < AMOUNT_LINES).select("doc_id", F.explode_outer(F.regexp_extract_all("texto", F.lit(AMOUNT), F.lit(1))).alias("t"))
    vote = T.separator_vote(F.col("t"))
    counts = tokens.groupBy("doc_id").agg(F.count_if(vote == ".").alias("puntos"), F.count_if(vote == ",").alias("comas"))
    return counts.select("doc_id", F.when(F.col("puntos") >= F.col("comas"), F.lit(".")).otherwise(F.lit(",")).alias("separador_miles"), "puntos", "comas")


def profile(lines: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """(doc_id, formato_codigo, separador_miles, requirio_ocr, rotacion_aplicada, confianza_base).

    ``ocr`` (doc_id, requirio_ocr, rotacion_aplicada) comes from a source that recognises scanned pages.
    """
    out = detect_code_format(lines).select("doc_id", "formato_codigo").join(detect_thousands_separator(lines).select("doc_id", "separador_miles"), "doc_id")
    if ocr is None:
        out = out.withColumns({"requirio_ocr": F.lit(False), "rotacion_aplicada": F.lit(0)})
    else:
        out = out.join(ocr, "doc_id", "left").withColumns({"requirio_ocr": F.coalesce("requirio_ocr", F.lit(False)), "rotacion_aplicada": F.coalesce("rotacion_aplicada", F.lit(0))})
    return out.withColumn("confianza_base", F.when(F.col("requirio_ocr"), 0.75).otherwise(1.0))


def best_rotation(scores: DataFrame) -> DataFrame:
    """(doc_id, rotacion): the rotation with the most words of three letters; the smaller one wins ties."""
    return scores.groupBy("doc_id").agg(F.max_by("rotacion", F.struct("palabras", -F.col("rotacion"))).alias("rotacion"))


def warnings(profiles: DataFrame, checks: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(doc_id, advertencias): texts for failed balance checks, recognised scans and documents without text."""
    joined = profiles.join(checks.select("doc_id", F.col("alerta").alias("_a")), "doc_id", "left")
    notes = [F.col("_a"), F.when(F.col("requirio_ocr"), F.lit("Documento leído por OCR: confianza reducida"))]
    out = joined.select("doc_id", F.array_compact(F.array(*notes)).alias("advertencias"))
    if empty is not None:
        out = out.unionByName(empty.select("doc_id", F.array(F.lit("No se extrajo texto")).alias("advertencias")))
    return out
