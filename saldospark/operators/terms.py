"""A stage for names that the cascade leaves open: cosine of character trigrams against known names.

Names are weighted trigram sets (padded, so that the first and last letter count), of length one. In an order of the trigrams
with the rare ones first, take the shortest prefix of a name behind which the rest is shorter than the threshold: two names with that
cosine have their first common trigram in both prefixes. So prefixes are the index, and the exact cosine is worked out for
names that meet there, once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldospark.functions import text as T

LEAST = 0.5


def trigrams(name: Column) -> Column:
    """The distinct trigrams of a name with a blank before and behind it; null for an empty name."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.when(F.length(name) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))))


def vectors(names: DataFrame, name: str, frequency: DataFrame, total: int, least: float) -> DataFrame:
    """``name`` with ``v`` (array of (o, g, w): order, trigram, weight; rare trigrams first, length one) and ``p`` (the trigrams of its prefix)."""
    grams = names.select(name).where(F.length(name) > 0).distinct().withColumn("g", F.explode(trigrams(F.col(name))))
    idf = F.log((1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    weighed = grams.join(frequency, "g", "left").withColumn("w", idf)
    v = weighed.groupBy(name).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "g", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    v = v.withColumn("_n", norm).withColumn("v", F.transform("v", lambda x: F.struct(x["o"].alias("o"), x["g"].alias("g"), (x["w"] / F.col("_n")).alias("w"))))
    rest = F.transform("v", lambda x, i: F.aggregate(F.slice("v", i + 1, F.size("v")), F.lit(0.0), lambda a, y: a + y["w"] * y["w"]))
    held = F.filter("v", lambda x, i: F.sqrt(F.get(F.col("_r"), i)) >= least - 1e-9)
    return v.withColumn("_r", rest).select(name, "v", F.transform(held, lambda x: x["g"]).alias("p"))


def matches(names: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """(nombre_norm, parecido, codigo, coseno): for each distinct name the known one with the greatest cosine, from ``least`` on.

    ``names`` has nombre_norm; ``known`` has clave (a normalised name) and codigo, one code for each. Document frequencies are those of the known
    names. Ties, to nine decimals, go to the smaller name; empty names match nothing.
    """
    keys = known.select("clave").where(F.length("clave") > 0).distinct()
    frequency = keys.select(F.explode(trigrams(F.col("clave"))).alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    total = keys.count()
    a = vectors(names, "nombre_norm", frequency, total, least).select("nombre_norm", F.col("v").alias("_a"), F.col("p").alias("_p"), F.explode("p").alias("key"))
    b = vectors(keys, "clave", frequency, total, least).select("clave", F.col("v").alias("_b"), F.col("p").alias("_q"), F.explode("p").alias("key"))
    met = a.join(b, "key").where(F.col("key") == F.element_at(F.array_intersect("_p", "_q"), 1))
    other = F.map_from_entries(F.transform("_b", lambda x: F.struct(x["g"], x["w"])))
    cosine = F.aggregate("_a", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(other, x["g"]), F.lit(0.0)))
    scored = met.select("nombre_norm", "clave", F.round(cosine, 9).alias("coseno")).where(F.col("coseno") >= least)
    best = scored.groupBy("nombre_norm").agg(F.max("coseno").alias("coseno"), F.min(F.struct((-F.col("coseno")).alias("o"), "clave"))["clave"].alias("parecido"))
    return best.join(known.select(F.col("clave").alias("parecido"), "codigo"), "parecido").select("nombre_norm", "parecido", "codigo", "coseno")


def known_names(dictionary: DataFrame, catalog: DataFrame) -> DataFrame:
    """(clave, codigo): normalised names of the dictionary (its last entry counts) and, where it has none, of the catalog (its first code)."""
    entries = dictionary.select(T.normalize_name(F.col("cuenta_original")).alias("clave"), F.struct(F.lit(0).alias("k"), (-F.col("seq")).alias("o"), F.col("codigo_estandar").alias("codigo")).alias("e"))
    codes = catalog.select(T.normalize_name(F.col("nombre_estandar")).alias("clave"), F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("o"), F.col("codigo_estandar").alias("codigo")).alias("e"))
    return entries.unionByName(codes).groupBy("clave").agg(F.min("e")["codigo"].alias("codigo"))


def suggest(result: DataFrame, dictionary: DataFrame, catalog: DataFrame, least: float = LEAST) -> DataFrame:
    """(nombre_norm, parecido, codigo, coseno, filas) for the names of rows without a code: what a reviewer may be offered, with how many rows it settles."""
    open_ = result.where("codigo_clasificado = ''").groupBy("nombre_original").agg(F.count("*").alias("n"))
    names = open_.groupBy(T.normalize_name(F.coalesce("nombre_original", F.lit(""))).alias("nombre_norm")).agg(F.sum("n").alias("filas"))
    return matches(names, known_names(dictionary, catalog), least).join(names, "nombre_norm").select("nombre_norm", "parecido", "codigo", "coseno", "filas")
