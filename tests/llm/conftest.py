import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket string, shard string, position string, score string, size string, n string, node string, start string, part string, estimate string, u string, rank string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * 13) for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: table(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids and sources, a very long text, repeated rows, ties, odd characters."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    rows = [(i, prose(rng, rng.randrange(1, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \t\r\n ", "en", "a"), (103, long, "en", "b"), (104, "one two three", None, "b"), (105, "One TWO three", "en", "b")]
    rows += [(106, "Größe ñandú 漢字 🙂 x̄  a<|endoftext|>b\n\n it's 1234", "de", "c"), (107, "same text here of words", "en", "c"), (107, "same text here of words", "en", "c"), (107, "another text of this id", "en", "c")]
    rows += [(None, "no id at all", "en", "a"), (None, None, None, None), (108, "x" * 5000, "en", "a"), (-5, "negative id", "en", "a")]
    return rows


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows).cache()


@pytest.fixture(scope="session")
def none(make, odd):
    return odd.limit(0)
