"""Documents for the tests: null, empty, very long, tied and repeated texts, with columns whose names clash with the operators' own."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, batch string, ids array<int>, id string, key long, spans string"
EXTRA = (7, 0.5, "b", [1], "i", 9, "s")
WORDS = "the of and shore lamp river stone green house winter paper field morning glass table cloud silver letter garden music".split()


def words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def texts():
    r = random.Random(5)
    base = [words(r, n) for n in (3, 40, 80, 200)]
    near = base[3].replace("river", "brook", 1)
    return [None, "", "   \n\t ", "¡ñandú! 漢字 😀", "a", base[0], base[1], base[1], base[2], base[3], near, "x" * 60_000, " ".join(["same"] * 20_000), base[1] + " " + base[2], base[2] + "\n" + base[1], "x" * 300, None]


def rows():
    out = [(i, t, "en", "src", len(t or ""), *EXTRA) for i, t in enumerate(texts())]
    return out + [out[6], (None, texts()[6], None, None, None, *EXTRA), (None, "only here, without an id", None, None, None, *EXTRA)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def written(spark, path, data=None):
    """The documents as files, which every plan reads alike."""
    documents(spark, data).repartition(3).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def simple(spark, texts, start=0):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start)], "doc_id long, text string")
