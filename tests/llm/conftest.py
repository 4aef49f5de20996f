import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("the", "ré", "und", "ño", "mix", "x") for b in ("", "alpha", "beta", "7", "ü", "zeta")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long = prose(120), prose(6000)
    rows = [
        (1, base, "en", "a", 3), (2, base, "en", "a", 3), (2, base, "en", "a", 3), (3, None, None, None, None), (4, "", "en", "b", 0),
        (None, prose(30), "en", "b", 1), (None, None, "en", None, 1), (5, "   \n\t ", "fr", "b", 5), (6, long, "fr", "b", 9), (7, prose(40) + " " + long[2000:9000], "fr", "a", 9),
        (8, base.replace("alpha", "gamma", 1), "en", "a", 3), (9, base.upper(), "en", "a", 3), (10, "one", "en", "c", 3), (11, "One two", "en", "c", 3), (12, "ééé" * 40, "fr", "c", 3), (13, "xé" + "ééé" * 40, "fr", "c", 3),
        (14, "Released under the MIT License. See the mit license", "en", "c", 3),
    ]
    return rows + [(100 + i, prose(rng.randint(1, 90)), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows_of():
    def read(df):
        return [r.asDict() if isinstance(r, Row) else r for r in df.collect()]

    return read
