"""Company data from the first lines of a document: tax id, name, period, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldospark.functions import text as T

HEADER_LINES, ID_LINES, NAME_LINES = 40, 20, 10
# The patterns.
TAX_ID = r"\b(\d{1,2}[\.\d]*\d{3}-[\dkK])\b"
TAX_ID_LABEL = r"(?:rut|r\.u\.t\.?|rut\s*n[oº°]?)\s*[:\s#Nº°]*\s*(\d{1,2}[\.\d]*\d{3}-[\dkK])"
NAME_LABEL = r"(?:empresa|company|razon\s*soc\.?|raz[oó]n\s*social|nombre)\s*[:\s]+([^\n\r]{3,80})"
ACTIVITY = r"(?:giro|actividad|rubro)\s*[:\s]+([^\n\r]{3,80})"
DATE = r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})"
FROM_TO = r"(?:desde|from|del?|período|periodo|al|a)\s*[:\s]*" + DATE + r"\s*(?:hasta|to|al|a)\s*" + DATE
CLOSING = r"al\s+(\d{1,2})\s+de\s+(\w+)\s+(?:de\s+)?(\d{4})"
YEAR = r"(?:año|ejercicio|periodo|al\s*31\s*de\s*diciembre)\s*(?:de\s*)?(\d{4})"
NO_NAME = r"^(balance|estado|rut|fecha|hora|pagina)"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iU)" + pattern, group), F.lit(""))


def extract_metadata(lines: DataFrame) -> DataFrame:
    """(doc_id, rut, razon_social, periodo_desde, periodo_hasta, giro, confianza) from lines (doc_id, linea, texto).

    Only the first 40 lines of a document are gathered, so a group is bounded. Labels win over the first line that
    fits; confidence is the share of tax id, name and period end that were found.
    """
    line = T.strip(F.col("texto"))
    bare = F.when(F.col("linea") < ID_LINES, F.nullif(F.regexp_extract("texto", "(?U)" + TAX_ID, 1), F.lit("")))
    named = (
        (F.col("linea") < NAME_LINES) & (F.length(line) > 5) & ~line.rlike(r"(?U)^[\d/\-\.:]+$") & ~T.matches(line, NO_NAME) & ~line.rlike("(?U)" + TAX_ID)
    )
    head = lines.where(F.col("linea") < HEADER_LINES).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linea", "texto"))), lambda x: x["texto"]), "\n").alias("_h"),
        F.min_by(bare, F.when(bare.isNotNull(), F.col("linea"))).alias("_id"),
        F.min_by(line, F.when(named, F.col("linea"))).alias("_name"),
    )
    h = F.col("_h")
    start, end = _first(h, FROM_TO, 1), _first(h, FROM_TO, 2)
    day, month, closing_year, year = _first(h, CLOSING, 1), _first(h, CLOSING, 2), _first(h, CLOSING, 3), _first(h, YEAR)
    opening = lambda y: F.concat(F.lit("01/01/"), y)
    out = head.select(
        "doc_id",
        T.strip(F.coalesce(_first(h, TAX_ID_LABEL), F.col("_id"))).alias("rut"),
        T.title_case(F.coalesce(T.strip(_first(h, NAME_LABEL)), F.col("_name"))).alias("razon_social"),
        F.coalesce(T.normalize_date(start), opening(closing_year), opening(year)).alias("periodo_desde"),
        F.coalesce(T.normalize_date(end), F.when(closing_year.isNotNull(), F.concat_ws("/", T.pad2(day), T.month_number(month), closing_year)), F.concat(F.lit("31/12/"), year)).alias("periodo_hasta"),
        T.title_case(T.strip(_first(h, ACTIVITY))).alias("giro"),
    )
    found = sum((F.col(c).isNotNull().cast("int") for c in ("rut", "razon_social", "periodo_hasta")), F.lit(0))
    return out.withColumn("confianza", found / 3)
