import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators might use themselves.
CLASHING = ["_id", "_fp", "kept", "size", "taken", "keep_id", "row", "_row", "_hash", "line", "k"]


def words(rng, n, alphabet="abcdefghij"):
    return [" ".join("".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(n))][0]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(1)
    long = words(rng, 6000)
    first = words(rng, 120)
    near = first.split()
    near[60] = "other"
    out = [
        (1, first, "en", "a", 5),
        (2, first, "en", "a", 5),
        (3, " ".join(near), "de", "b", 5),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \t\n ", "en", "a", 3),
        (7, long, "fr", "b", 1),
        (8, long, "fr", "c", 1),
        (9, "Ärger ÉTÉ straße İx K", "de", "c", 1),
        (None, "no id here", "en", None, 2),
        (None, first, "en", "d", 2),
        (10, "one two", "en", "a", 2),
        (10, "one two", "en", "a", 2),
        (11, "same", "en", "a", 1),
        (11, "different", "en", "a", 1),
    ]
    out += [(100 + i, words(rng, rng.randint(1, 80)), "en", rng.choice("abcde"), 9) for i in range(60)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
