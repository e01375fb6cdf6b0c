import random

import pytest
from pyspark.sql import functions as F

#: Columns that documents may have besides their own, named like what operators make inside.
CLASHES = ["size", "source_size", "target", "part", "h", "start", "chunk", "shard", "slot", "digest", "keep_id", "kept", "id", "key", "to", "tail", "words", "hits", "row", "band", "component", "lang_pred", "score", "n", "doc", "__row"]


def make_docs(spark, rows, clash=False):
    """Documents (doc_id, text, lang, source) in two partitions, with clashing columns if asked."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHES)}) if clash else docs


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, ties, repeated rows, null ids and sources, one very long text."""
    rng = random.Random(5)
    long = words(rng, 20_000, 5000)
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
        (2, "alpha  beta\tgamma delta\nepsilon zeta", "en", "a"),
        (2, "alpha  beta\tgamma delta\nepsilon zeta", "en", "a"),
        (3, "", "fr", None),
        (4, None, None, "b"),
        (5, " \t\n ", "de", ""),
        (6, long, "en", "b"),
        (7, long + " tail", None, None),
        (None, "no id here at all", "en", "c"),
        (8, "123 456 !!", "es", "c"),
        (9, "Ünïcödé 日本語 😀 mixed <|im_end|> text", "de", "a"),
        (10, "one", "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make_docs(spark, odd_rows, clash=True).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make_docs(spark, [])
