"""Similarity join of names through an inverted index with computed prefixes.

The score of two strings is 200 LCS / (n + m), and the common subsequence is at most the number of characters both have, counted with
repetition. Characters numbered among equal ones make that an overlap of sets, so a score of ``least`` asks for an overlap of
alpha = ceil(least / 200 (n + m)). In one common order of the characters, rare ones first, two sets with that overlap have at least two common
elements among the first n - alpha + 2 of the one and m - alpha + 2 of the other. The index therefore holds pairs of
prefix elements; two names meet where they share one, once (at the first pair they share), within the bounds of
length, and only if the characters in common are enough. The common subsequence decides.

An order that is fixed beforehand needs no pass over the data; it bears on the number of candidates only, not on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldospark.functions import text as T

#: Characters from rare to frequent in account names; others come before, as rare ones.
RARE_FIRST = "wkxñzjhqyfvgbpumtcdlnirosae0123456789 "
#: Below this score strings of one and two characters could match by a single common one.
LEAST = 67.0


def _ordered(text: Column) -> Column:
    """The numbered characters of a string, rare first: higher numbers before lower ones, then by ``RARE_FIRST``."""
    chars = F.split(text, "")
    numbered = F.transform(chars, lambda x, i: F.struct((-F.size(F.filter(F.slice(chars, F.lit(1), i), lambda y: y == x))).alias("n"), F.position(x, F.lit(RARE_FIRST)).alias("r"), x.alias("x")))
    return F.transform(F.array_sort(numbered), lambda s: F.concat(s["x"], (-s["n"]).cast("string")))


def shortest_partner(n: Column, least: float) -> Column:
    """Length of the shortest string that can have the score with one of length ``n``."""
    return F.ceil(n * least / (200 - least) - 1e-9).cast("int")


def indexed(names: DataFrame, text: str, least: float, tag: str) -> DataFrame:
    """``names`` with ``<tag>n`` (length), ``<tag>c`` (ordered characters), ``<tag>p`` (prefix), and a row for each ``key``: pairs of prefix characters, and the string itself.

    The string itself stands for strings of one character, which have no pair.
    """
    n, c, p = f"{tag}n", f"{tag}c", f"{tag}p"
    df = names.where(F.length(text) > 0).withColumn(n, F.length(text)).withColumn(c, _ordered(F.col(text)))
    alpha = F.ceil((F.col(n) + shortest_partner(F.col(n), least)) * least / 200 - 1e-9).cast("int")
    df = df.withColumn(p, F.slice(c, F.lit(1), F.least(F.col(n), F.col(n) - alpha + 2)))
    pairs = F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: F.concat_ws("\0", x, y))))
    return df.withColumn("key", F.explode(F.concat(pairs, F.array(F.concat(F.lit("\1"), F.col(text))))))


def candidates(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs of rows that the index proposes, each once: all pairs with a score of ``least`` or more are among them.

    ``left`` and ``right`` have no column but ``a`` and ``b`` in common use here; null and empty strings match nothing.
    """
    if least < LEAST:
        raise ValueError(f"the index finds all pairs from a score of {LEAST} on")
    first = F.slice(F.array_intersect("_lp", "_rp"), 1, 2)
    once = (F.col("key") == F.array_join(first, "\0")) | ((F.size(first) < 2) & (F.col(a) == F.col(b)) & F.col("key").startswith("\1"))
    close = (F.col("_rn") >= shortest_partner(F.col("_ln"), least)) & (F.col("_ln") >= shortest_partner(F.col("_rn"), least))
    met = indexed(left, a, least, "_l").join(indexed(right, b, least, "_r"), "key").where(close & once)
    enough = 200.0 * F.size(F.array_intersect("_lc", "_rc")) >= least * (F.col("_ln") + F.col("_rn"))
    return met.where(enough).drop("key", "_lp", "_rp", "_lc", "_rc", "_ln", "_rn")


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float, score: str = "puntaje") -> DataFrame:
    """Rows of ``left`` and ``right`` whose strings have a score of ``least`` or more, with the score."""
    return candidates(left, right, a, b, least).withColumn(score, T.similarity(F.col(a), F.col(b))).where(F.col(score) >= least)
