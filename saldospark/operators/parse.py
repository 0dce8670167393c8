"""Lines of text to accounts, as a chain of native expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.functions.plan import fence
from saldospark.operators.profile import profile
from saldospark.rules import patterns, special

# Codes at the start of a line, by format.
LINE_CODES = {"guion": r"^(\d+(?:-\d+){2,})\s+(.+)", "punto": r"^(\d+(?:\.\d+){2,})\s+(.+)", "compacto": r"^(\d{6,10})\s+(.+)"}
COLUMNS = ("activo", "pasivo", "perdida", "ganancia")


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, linea, texto): the lines of each text, numbered from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("linea", "texto"))


def _code(line: Column, fmt: Column) -> Column:
    """The code at the start of a line, or null. A document of known format uses that pattern only; without one, three are tried."""
    part = {f: F.nullif(F.regexp_extract(line, "(?U)" + p, 1), F.lit("")) for f, p in LINE_CODES.items()}
    out = F.coalesce(*[part[f] for f in ("punto", "guion", "compacto")])
    for f in LINE_CODES:
        out = F.when(fmt == f, part[f]).otherwise(out)
    return out


#: Up to two last words without a digit and of at most two characters.
_IDLE = r"(?U)(?:(?:^| )[^\d ]{1,2}){1,2}$"
#: Words that stand for amounts, at the end: a dash, the letter o for a zero, or an amount with currency signs anywhere.
_AMOUNTS = r"((?:(?:^| )(?:[oO]|-|\$*-?\$*\(?\$*(?:[\d.,]\$*){1,18}\)?\$*))*)$"


def _clean(word: Column) -> Column:
    return F.when(word.isin("o", "O", "-"), F.lit("0")).otherwise(F.replace(word, F.lit("$"), F.lit("")))


def parse_lines(lines: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Accounts (doc_id, linea, codigo, nombre, monto, origen_columna, es_total, confianza_extraccion) of lines.

    Lines under four characters and names under three are dropped. Profiles are made from the lines if not given;
    they have one row per document and are joined by its id. Each step reads the columns of the one before; one pattern cuts
    all amounts off a line, and at most the last four are read.
    """
    lines = lines.withColumn("texto", T.fix_ocr_code(F.col("texto")))  # the profile reads mended codes too
    profiles = profile(lines) if profiles is None else profiles
    # lines are dealt out by document and meet a hash table of their profiles: neither side is broadcast on an estimate
    df = lines.join(profiles.select("doc_id", "formato_codigo", "separador_miles", "confianza_base").hint("shuffle_hash"), "doc_id")
    df = df.select("doc_id", "linea", "formato_codigo", "separador_miles", "confianza_base", T.strip(F.col("texto")).alias("_l"))
    df = df.withColumn("codigo", _code(F.col("_l"), F.col("formato_codigo")))
    rest = F.substr("_l", F.coalesce(F.length("codigo"), F.lit(0)) + 1)
    df = df.withColumn("_t", F.regexp_replace(F.btrim(F.regexp_replace(rest, r"(?U)\s+", " ")), _IDLE, ""))
    df = df.withColumn("_m", F.regexp_extract("_t", _AMOUNTS, 1))
    df = df.withColumn("nombre", F.btrim(F.left("_t", F.length("_t") - F.length("_m")), F.lit(" .-")))
    tail = F.btrim("_m")
    df = df.select("doc_id", "linea", "codigo", "nombre", "separador_miles", "confianza_base", F.char_length("_l").alias("_size"), F.split(F.nullif(tail, F.lit("")), " ").alias("_a"))
    df = fence(df).where((F.col("_size") >= 4) & (F.char_length("nombre") >= 3))
    df = df.withColumn("_n", F.coalesce(F.size("_a"), F.lit(0))).withColumn("es_total", F.col("nombre").rlike("(?iU)^" + patterns.TOTAL))
    wide = F.col("_n") >= 4
    last = F.when(wide, F.slice("_a", -4, 4)).otherwise(F.col("_a"))
    df = df.withColumn("_v", F.transform(last, lambda t: T.parse_amount(_clean(t), F.col("separador_miles"), bare=True)))
    # of four columns the first amount that isn't zero counts, of fewer the last
    hits = F.transform("_v", lambda v: F.coalesce(v != 0, F.lit(False)))
    df = df.withColumn("_p", F.coalesce(F.nullif(F.array_position(F.when(wide, hits).otherwise(F.reverse(hits)), True), F.lit(0)), F.lit(1)).cast("int"))
    amount = F.try_element_at("_v", F.when(wide, F.col("_p")).otherwise(-F.col("_p")))
    root, low = F.left(F.translate(F.col("codigo"), ".-", ""), F.lit(1)), F.lower("nombre")
    by_root = (
        F.when(root == "1", F.lit("activo")).when(root == "2", F.lit("pasivo"))
        .when(root == "3", F.when(T.contains_any(low, ("capital", "patrimonio")), F.lit("pasivo")).otherwise(F.lit("perdida")))
        .when(root == "4", F.lit("perdida")).when(root == "5", F.lit("ganancia"))
    )
    by_word = F.coalesce(*[F.when(T.contains_any(low, words), F.lit(o)) for o, words in special.COLUMN_WORDS.items()])
    origin = (
        F.when(wide, F.element_at(F.array(*map(F.lit, COLUMNS)), F.col("_p")))
        .when(F.col("_n") > 0, F.coalesce(by_root, by_word, F.lit("desconocido"))).otherwise(F.lit("desconocido"))
    )
    return df.select("doc_id", "linea", "codigo", "nombre", amount.alias("monto"), origin.alias("origen_columna"), "es_total", F.col("confianza_base").alias("confianza_extraccion"))


def parse_cells(rows: DataFrame) -> DataFrame:
    """Accounts from spreadsheet rows (doc_id, linea, cells array<struct<kind, s, d>>), kind "s" (text), "n" (number), "d" (date) or null cells.

    The name is the longest text (the first of equals), the code the first cell if it is digits, dots and dashes,
    the amount the last number. Rows without a text of three characters are dropped.
    """
    full = F.filter("cells", lambda c: c["kind"].isNotNull())
    df = rows.withColumn("_c", full).withColumn("_s", F.filter("_c", lambda c: c["kind"] == "s")).withColumn("_d", F.filter("_c", lambda c: c["kind"] == "n"))
    ranked = F.transform("_s", lambda c, i: F.struct(F.char_length(c["s"]).alias("n"), (-i).alias("i"), c["s"].alias("s")))
    df = df.withColumn("nombre", F.array_max(ranked)["s"]).where(F.char_length("nombre") >= 3)
    first = F.when(F.col("_c")[0]["kind"] == "s", F.col("_c")[0]["s"]).otherwise(F.coalesce(F.col("_c")[0]["s"], F.col("_c")[0]["d"].cast("string")))
    code = F.when(first.rlike(r"^[\d.\-]+$") & (first != F.col("nombre")), first)
    return df.select("doc_id", "linea", code.alias("codigo"), "nombre", F.try_element_at(F.col("_d"), F.lit(-1))["d"].alias("monto"),
                     F.lit("desconocido").alias("origen_columna"), F.lit(False).alias("es_total"), F.lit(0.9).alias("confianza_extraccion"))
