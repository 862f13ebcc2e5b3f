import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every kind of oddity: nulls, empty, short and long texts, repeats, other scripts, clashing columns."""
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "déjà", "日本語", "x1", "LICENSE", "the", "mit", "token", "=", "\n\n", "😀"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    body = " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(300))
    rows = [
        (1, None),
        (2, ""),
        (3, "a"),
        (4, body),
        (4, body),
        (5, body),
        (None, body + " one more"),
        (None, None),
        (7, long),
        (8, long[:200_000] + "tail"),
        (9, "under the MIT license"),
        (10, 'token = "abcdefghijkl1234"'),
        (11, "aaaa" * 500),
        (12, "\x00\x01 control"),
        (12, "tie"),
    ]
    full = [(i, t, "en", "s", 0, -1, -2, "was", "old") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA + ", rid long, slot long, score string, _text string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet").cache()


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
