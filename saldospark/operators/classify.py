"""Classification of accounts: code prefixes, dictionary, fuzzy dictionary, regex rules, corrections, special rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldospark.functions import text as T
from saldospark.functions.plan import BROADCAST_ROWS, cut, fence, spread
from saldospark.operators.similar import similar_pairs
from saldospark.rules import patterns, prefixes, special
from saldospark.schemas import REVIEW_BELOW

FUZZY_MIN = 90.0


def by_code_prefix(df: DataFrame, code: str = "codigo") -> DataFrame:
    """Add ``cod_codigo``, ``cod_confianza`` and ``cod_formato``: the standard code of the longest known prefix.

    Every pattern is a literal prefix of one of two lengths per format, so the ranked search is two equi-joins
    with a table of fixed size. Codes of unknown format or prefix give nulls.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(prefixes.expanded(), "fmt string, prefix string, code string, conf double")
    long = table.where(F.length("prefix") >= 5)
    short = table.where(F.length("prefix") == 4)
    trimmed = T.strip(F.coalesce(F.col(code), F.lit("")))
    out = df.withColumn("_code", trimmed).withColumn("cod_formato", T.loose_code_format(F.col("_code"), bare=True))
    first = F.when(F.col("cod_formato") == "compacto", F.left("_code", F.lit(5))).otherwise(F.left("_code", F.lit(7)))
    a = F.broadcast(long.select(F.col("fmt").alias("_f1"), F.col("prefix").alias("_p1"), F.col("code").alias("_c1"), F.col("conf").alias("_k1")))
    b = F.broadcast(short.select(F.col("fmt").alias("_f2"), F.col("prefix").alias("_p2"), F.col("code").alias("_c2"), F.col("conf").alias("_k2")))
    out = out.join(a, (F.col("cod_formato") == F.col("_f1")) & (first == F.col("_p1")), "left")
    out = out.join(b, (F.col("cod_formato") == F.col("_f2")) & (F.left("_code", F.lit(4)) == F.col("_p2")), "left")
    return out.withColumn("cod_codigo", F.coalesce("_c1", "_c2")).withColumn("cod_confianza", F.coalesce("_k1", "_k2")).drop(
        "_code", "_f1", "_p1", "_c1", "_k1", "_f2", "_p2", "_c2", "_k2"
    )


def dedupe_dictionary(dictionary: DataFrame) -> DataFrame:
    """(clave, codigo_estandar, pos): the last entry of each normalised name, at the place of the first one."""
    keyed = dictionary.withColumn("clave", T.normalize_name(F.col("cuenta_original")))
    return keyed.groupBy("clave").agg(F.max_by("codigo_estandar", "seq").alias("codigo_estandar"), F.min("seq").alias("pos"))


def by_dictionary(df: DataFrame, dictionary: DataFrame, norm: str = "nombre_norm") -> DataFrame:
    """Add ``dic_codigo``: the code of the dictionary entry with the same normalised name."""
    entries = dedupe_dictionary(dictionary).select(F.col("clave").alias("_clave"), F.col("codigo_estandar").alias("dic_codigo"))
    return df.join(entries, F.col(norm) == F.col("_clave"), "left").drop("_clave")


def fuzzy_matches(names: DataFrame, dictionary: DataFrame, norm: str = "nombre_norm") -> DataFrame:
    """(nombre_norm, fuz_codigo, fuz_clave, fuz_puntaje): the most similar entry of each distinct name, from ``FUZZY_MIN``.

    Names are compared with sorted words, through the index of ``similar``. Ties go to the earlier entry. Empty
    names match nothing.
    """
    entries = dedupe_dictionary(dictionary).select(T.token_sort(F.col("clave")).alias("_b"), F.col("clave").alias("_clave"), F.col("codigo_estandar").alias("_code"), F.col("pos").alias("_pos"))
    asked = names.select(norm).where(F.col(norm) != "").distinct().withColumn("_a", T.token_sort(F.col(norm)))
    scored = similar_pairs(asked, entries, "_a", "_b", FUZZY_MIN, "_s")
    best = scored.groupBy(norm).agg(F.max(F.struct("_s", (-F.col("_pos")).alias("_o"), "_code", "_clave")).alias("m"))
    return best.select(norm, F.col("m._code").alias("fuz_codigo"), F.col("m._clave").alias("fuz_clave"), F.col("m._s").alias("fuz_puntaje"))


def regex_rule(name: Column) -> Column:
    """struct(conf, prio, code) of the rule with the highest confidence, then the earlier one; null if none matches.

    The patterns are literals, so each compiles once.
    """
    hits = [F.when(T.matches(name, p), F.struct(F.lit(conf).alias("conf"), F.lit(-i).alias("prio"), F.lit(code).alias("code"))) for i, (p, code, conf) in enumerate(patterns.RULES)]
    return F.array_max(F.array_compact(F.array(*hits)))


def ambiguous_sides(name: Column) -> Column:
    """struct(ingreso, gasto): the codes of a name that means income or expense depending on its column; nulls otherwise."""
    sides = [F.create_map(*[F.lit(x) for word, codes in special.AMBIGUOUS_NAMES.items() for x in (word, codes[i])]) for i in (0, 1)]
    return F.struct(F.try_element_at(sides[0], name).alias("ingreso"), F.try_element_at(sides[1], name).alias("gasto"))


def by_side(sides: Column, origin: Column) -> Column:
    """The code of a struct(ingreso, gasto) for the column that an amount stands in; null in any other column."""
    return F.when(origin.isin(*special.INCOME_SIDE), sides["ingreso"]).when(origin.isin(*special.EXPENSE_SIDE), sides["gasto"])


def ambiguous_code(name: Column, origin: Column) -> Column:
    """Code of a name that means income or expense depending on its column; null otherwise."""
    return by_side(ambiguous_sides(name), origin)


def correction_marks(name: Column) -> Column:
    """What the column's correction asks of a name: struct(sobregiro, pares), pares the codes of its keywords in order (null if it has none)."""
    pairs = F.array_compact(F.array(*[F.when(name.contains(word), F.struct(F.lit(a).alias("ingreso"), F.lit(b).alias("gasto"))) for word, a, b in special.AMBIGUOUS_WORDS]))
    return F.struct(T.contains_any(name, special.OVERDRAFT_WORDS).alias("sobregiro"), F.when(F.size(pairs) > 0, pairs).alias("pares"))


def marked_correction(marks: Column, code: Column, origin: Column, amount: Column) -> Column:
    """``column_correction`` of a name with the given ``correction_marks``."""
    overdraft = F.when((amount < 0) & (origin == "activo") & (code == "AC.01") & marks["sobregiro"], F.lit("PC.02"))
    other = F.filter(marks["pares"], lambda p: (code != p["ingreso"]) & (code != p["gasto"]))
    return F.coalesce(overdraft, F.when(marks["pares"].isNotNull(), by_side(F.try_element_at(other, F.lit(1)), origin)))


def column_correction(name: Column, code: Column, origin: Column, amount: Column) -> Column:
    """The code that the column of an amount asks for, or null."""
    return marked_correction(correction_marks(name), code, origin, amount)


def name_marks(raw_name: Column) -> Column:
    """What the special rules ask of a name, which is only lowered and stripped: a struct of booleans (null for a null name)."""
    name = T.strip(F.lower(raw_name))
    return F.struct(
        T.contains_any(name, special.BANK_WORDS).alias("bank"), name.rlike("(?U)" + special.LAND).alias("land"), name.rlike("(?U)" + special.DEFERRED_INCOME).alias("deferred"),
        T.contains_any(name, special.CLIENT_WORDS).alias("client"), name.rlike("(?U)" + special.SHAREHOLDER).alias("holder"),
    )


def special_rule(marks: Column, code: Column, amount: Column, activity: Column, fold_accents: bool = False) -> Column:
    """struct(codigo_final, flag) of the first of five credit rules that applies, or null. ``marks`` are those of the name (``name_marks``)."""
    giro = F.translate(F.lower(activity), "áéíóú", "aeiou") if fold_accents else F.lower(activity)
    negative = F.coalesce(amount < 0, F.lit(False))
    conditions = (
        negative & ((code == "AC.01") | marks["bank"]),
        (code == "ANC.01") & marks["land"] & F.coalesce(T.contains_any(giro, special.PROPERTY_SECTORS), F.lit(False)),
        marks["deferred"] & (code.startswith("AC") | code.startswith("ANC")),
        negative & (code.isin("AC.03", "AC.04") | marks["client"]),
        marks["holder"],
    )
    targets = ("PC.02", "AC.05", "PC.08", "PC.08", "AC.06S")
    return F.coalesce(*[F.when(c, F.struct(F.lit(t).alias("codigo_final"), F.lit(f).alias("flag"))) for c, t, f in zip(conditions, targets, special.FLAGS)])


def name_facts(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All that the cascade asks of an account's name, a row for each distinct ``nombre`` of ``names``.

    (nombre, nombre_norm, dic_codigo, fuz_codigo, fuz_puntaje, regla, marcas). Similarity and patterns are worked out only for names
    that the dictionary doesn't have. ``names`` is read twice.
    """
    named = by_dictionary(names.select("nombre").withColumn("nombre_norm", T.normalize_name(F.coalesce(F.col("nombre"), F.lit("")))), dictionary)
    fuzzy = fuzzy_matches(named.where("dic_codigo is null"), dictionary).select(F.col("nombre_norm").alias("_m"), "fuz_codigo", "fuz_puntaje")
    ruled = F.when(F.col("dic_codigo").isNull(), regex_rule(F.col("nombre_norm")))
    return named.join(fuzzy, F.col("nombre_norm") == F.col("_m"), "left").select(
        "nombre", "nombre_norm", "dic_codigo", "fuz_codigo", "fuz_puntaje", ruled.alias("regla"), name_marks(F.col("nombre")).alias("marcas")
    )


def _cascade(accounts: DataFrame, dictionary: DataFrame, activity: str | None) -> DataFrame:
    """``accounts`` with the cascade's columns, as plain expressions over the facts of the name and of the code.

    Account names repeat from document to document, so facts are worked out once per distinct name: the names are cut (the only
    job that runs here, with a count of what it wrote) and joined back, by broadcast if they are few. Otherwise accounts are shuffled
    by name and run past a hash table of the names' facts: a task holds its share of the names and sorts no accounts, however many
    have one name (adaptive execution splits such a partition).
    """
    names = cut(accounts.select("nombre").distinct())
    known = names.count()
    facts = name_facts(spread(names, known), dictionary)
    by_dic, by_fuzzy, by_rule = (F.col(c).isNotNull() for c in ("dic_codigo", "fuz_codigo", "regla"))
    facts = facts.select(
        F.col("nombre").alias("_name"), "nombre_norm", "marcas", ambiguous_sides(F.col("nombre_norm")).alias("_sides"), correction_marks(F.col("nombre_norm")).alias("_words"),
        F.coalesce("dic_codigo", "fuz_codigo", F.col("regla.code")).alias("_cn"),
        F.when(by_dic, F.lit("diccionario_exacto")).when(by_fuzzy, F.lit("diccionario_fuzzy")).when(by_rule, F.lit("regla_regex")).otherwise(F.lit("sin_clasificar")).alias("_mn"),
        F.when(by_dic, F.lit(0.98)).when(by_fuzzy, F.bround(0.80 + (F.col("fuz_puntaje") - 90) * 0.01, 3)).when(by_rule, F.col("regla.conf")).otherwise(F.lit(0.0)).alias("_kn"),
    )
    facts = F.broadcast(facts) if known <= BROADCAST_ROWS else facts.hint("shuffle_hash")
    df = by_code_prefix(accounts).join(facts, F.col("nombre").eqNullSafe(F.col("_name")), "left").drop("_name")

    origin = F.col("origen_columna")
    by_code = F.col("cod_codigo").isNotNull()
    df = df.withColumn("_amb", by_side(F.col("_sides"), origin))
    df = df.select(
        "*", F.coalesce("cod_codigo", "_cn").alias("_c0"), F.when(by_code, F.lit("codigo")).otherwise(F.col("_mn")).alias("_m0"),
        F.when(by_code, F.col("cod_confianza")).otherwise(F.col("_kn")).alias("_k0"),
    )
    df = df.withColumn("_asked", F.when((origin != "desconocido") & F.col("_c0").isNotNull(), marked_correction(F.col("_words"), F.col("_c0"), origin, F.col("monto"))))
    df = df.withColumn("_fix", F.nullif("_asked", "_c0"))
    df = df.withColumn("_c1", F.coalesce("_fix", "_c0")).withColumn("_fixed", F.col("_fix").isNotNull())
    giro = F.col(activity) if activity else F.lit(None).cast("string")
    df = df.withColumn("_sp", special_rule(F.col("marcas"), F.coalesce("_c1", F.lit("AC.08")), F.col("monto"), giro))
    early, ruled = F.col("_amb").isNotNull(), F.col("_sp").isNotNull()
    method = F.concat("_m0", F.when(F.col("_fixed"), F.lit("+columna")).otherwise(F.lit("")),
                      F.when(ruled, F.concat(F.lit("+regla_especial("), F.col("_sp.flag"), F.lit(")"))).otherwise(F.lit("")))
    confidence = F.when(F.col("_fixed"), F.least(F.col("_k0") + 0.05, F.lit(0.99))).otherwise(F.col("_k0"))
    return (
        df.withColumn("codigo_clasificado", F.coalesce(F.when(early, F.col("_amb")).when(ruled, F.col("_sp.codigo_final")).otherwise(F.col("_c1")), F.lit("")))
        .withColumn("metodo", F.when(early, F.lit("columna_ambiguo")).otherwise(method))
        .withColumn("metodo_base", F.when(early, F.lit("columna_ambiguo")).otherwise(F.col("_m0")))
        .withColumn("confianza", F.when(early, F.lit(0.88)).otherwise(confidence))
        .withColumn("requiere_revision", F.col("confianza") < REVIEW_BELOW)
        .withColumn("nota", F.when(~early & ruled, F.col("_sp.flag")).otherwise(F.lit("")))
    )


def classify(accounts: DataFrame, dictionary: DataFrame, activity: str | None = None) -> DataFrame:
    """The whole cascade: adds codigo_clasificado ('' if none), metodo, confianza, requiere_revision and nota to accounts.

    Accounts have doc_id, linea, codigo, nombre, monto, origen_columna and es_total; ``activity`` names a column with
    the company's activity.
    """
    added = ("nombre_norm", "codigo_clasificado", "metodo", "confianza", "requiere_revision", "nota")
    return fence(_cascade(accounts, dictionary, activity).select(*accounts.columns, *added))


def classified(accounts: DataFrame, dictionary: DataFrame, activity: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """``result_table(classify(...))``, or of it only the given ``columns``: what they don't need isn't worked out.

    ``metodo_base``, the method without its corrections, and the column ``activity`` can be asked for too.
    """
    df = _cascade(accounts, dictionary, activity)
    more = ("metodo_base", *([activity] if activity else []))
    return fence(result_table(df, *more).select(*columns) if columns else result_table(df))


def is_account(df: DataFrame) -> DataFrame:
    """Rows with an amount or a code; without a code, only names that aren't headers or other noise."""
    code = F.coalesce(F.col("codigo"), F.lit(""))
    noise = T.strip(F.col("nombre")).rlike("(?iU)^" + patterns.NOT_AN_ACCOUNT)
    return df.where(~(F.col("monto").isNull() & (code == "")) & ~((code == "") & F.coalesce(noise, F.lit(False))))


def result_table(df: DataFrame, *more: str) -> DataFrame:
    """The result's columns, with '' for a missing code, original code or note, and ``more`` columns."""
    return df.select(
        "doc_id", "linea", F.coalesce("codigo", F.lit("")).alias("codigo_original"), F.col("nombre").alias("nombre_original"), "monto", "origen_columna",
        "es_total", "codigo_clasificado", "metodo", "confianza", "requiere_revision", "nota", "confianza_extraccion",
        F.col("origen_columna").alias("origen_columna_display"), *more,
    )
