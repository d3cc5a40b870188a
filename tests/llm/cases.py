"""Documents that every operator has to take: nulls, empty and very long texts, repeated rows, extra columns."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, toxic string, copy int, rate double, doc string, rep long, _n int"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "r", "l") for c in ("a", "e", "i", "o", "ur", "en", "ach")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def texts() -> list[tuple]:
    long = prose(99, 30_000)
    rows = [
        (1, prose(1, 300)),
        (2, None),
        (3, ""),
        (4, "   \n\t "),
        (5, "One"),
        (6, "one"),
        (7, "!!! ??? ..."),
        (8, prose(1, 300)),
        (8, prose(1, 300)),
        (None, prose(1, 300)),
        (9, long),
        (10, "same " * 500),
        (11, "Ünï çödé 日本語 😀 é ﬁ"),
        (12, "a\x00b c"),
        (13, prose(2, 300)),
        (14, " ".join(prose(2, 300).split()[:290]) + " kana losa"),
    ]
    return [(i, t, "en" if n % 2 else None, None if n % 5 == 0 else f"s{n % 3}", None, 0.5, "x", 7, 1.5, "d", 3, 1) for n, (i, t) in enumerate(rows)]


def odd_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(texts(), SCHEMA)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows=((1, 1, 0), (8, 1, 0), (13, 0, 1), (None, 1, 1), (5, None, None))) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
