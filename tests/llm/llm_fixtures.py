import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"
FULL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, the same in every run."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))
    return text


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """NULLs in any column, empty and long texts, repeated rows, and columns whose names operators use."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "one", "en", None, 3),
            (None, prose(30, 1), "en", "a", 1), (5, prose(30, 2), "en", "a", 1), (5, prose(30, 2), "en", "a", 1),
            (6, prose(6000, 3), "fr", "b", 1), (7, prose(30, 2), "en", "b", 1), (8, "Émile  éa <|endoftext|> x", "fr", "b", 1)]
    df = spark.createDataFrame(rows, FULL)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in ("id", "row", "key", "node", "score", "size", "h", "a", "shard")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], FULL)
