import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"

#: columns that operators use inside, as further columns of the input
CLASH = ["unit", "size", "block", "p", "c", "rep", "sig", "n", "m", "idx", "dk", "__key", "file", "stratum", "x", "low"]


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, a long one, ties and repeated rows."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 40, 3000) for _ in range(300))
    rows = [(0, None, "en", "a", None), (1, "", None, None, 0), (2, " \n\t ", "en", None, 4), (None, "a b c", "en", "b", 5),
            (None, None, None, None, None), (3, "one", "de", "b", 3), (4, long, "en", "b", len(long)), (5, long, "en", "a", len(long)),
            (6, words(rng, 60), "fr", "c", 1), (6, words(rng, 60), "fr", "c", 1)]
    return rows + [rows[8]] * 3


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def rows_of(df, *cols):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=lambda r: str(key(r)))
