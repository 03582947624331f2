"""Documents with all that may be odd: nulls, empty and long texts, ties, repeated rows, and
other columns that bear the names the operators use themselves."""

import random

import pytest

CLASHES = "shard int, size string, slot int, hash string, text_crc32 string, node string, label string, n int, ids string, key string, kept string, a string, b string, tag string, _doc string, doc string, cell int, bucket int, spans string, low string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def rows(texts, sources=None):
    clash = (None,) * len(CLASHES.split(","))
    return [(d, t, "en", (sources or {}).get(d, f"s{(d or 0) % 3}"), len(t or ""), *clash) for d, t in texts]


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


LONG = words(1, 60_000, 5000)
BASE = words(2, 300, 5000)
NEAR = BASE.replace(" ", "  ", 3).rsplit(" ", 4)[0] + " other end"
TEXTS = [
    (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One TWO"), (9, LONG), (10, LONG + " more"),
    (11, words(3, 120)), (11, words(3, 120)), (12, words(4, 80) + "\n" + words(5, 30) + "\n" + words(6, 30)), (13, words(7, 40) + "\n" + words(5, 30) + "\n" + words(6, 30)),
    (None, words(8, 60)), (14, "naïve café ßtraße " * 30), (15, "x" * 5000), (16, "日本語 テキスト " * 40), (17, "the the the " * 60), (18, "<|endoftext|> special </s> <s> strings"), (19, "a\x00b \x1c c d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, sources=None: spark.createDataFrame(rows(texts, sources), SCHEMA)
