"""Small tables with every kind of odd row."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["tha", "re", "on", "ing", "é", "st", "o", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randint(5, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), 1) for i in range(n)]
    base = prose(rng, 200)
    out += [(1000 + i, base, "en", "hot", 1) for i in range(5)]  # copies
    out += [(1100 + i, base + " tail" * i, "en", "hot", 1) for i in range(4)]  # near copies
    out += [(2000, None, "en", "a", None), (2001, "", None, None, 0), (2002, " \n\t", "en", "b", 3), (None, "no id here", "en", "a", 10)]
    out += [(2003, "word " * 30_000, "en", "long", 150_000), (2004, "x" * 50_000, "en", "long", 50_000), (2005, "1" * 20_000 + "@" + "a." * 5_000, "en", "b", 1)]
    out += [out[3], out[3]]  # repeated rows
    out += [(2006, "aaaa\U0001f600é漢字 ok", "en", "a", 1), (2007, "a", "en", "a", 1)]
    return out


def docs(spark, given=None):
    """With extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if given is None else given, DOCS)
    return df.withColumn("fp", F.lit("x")).withColumn("size", F.lit(-1)).withColumn("score", F.lit("y")).withColumn("row", F.lit(0)).withColumn("bucket", F.lit("z"))
