"""What the plans of operators over whole corpora must not do twice."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks, retrieval, structure


def _plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a", "alpha beta beta. Beta gamma.", "t"), ("b", "beta", "t t"), ("c", None, None)], "node_id string, text string, title string")


def test_hints_of_whole_texts_exchange_texts_once(docs):
    hints = T.text_hints(docs, "text")
    assert _plan(hints, "executedPlan").count("Exchange ") == 1
    assert {r.node_id: r.hints for r in hints.collect()} == {"a": ["beta", "alpha", "gamma"], "b": ["beta"]}


def test_sentence_idfs_exchange_sentences_once(docs):
    rows = docs.select("node_id", F.split("text", r"\.").alias("s"))
    found = chunks.sentence_idfs(rows, "s", "node_id").groupBy("node_id").count()
    assert _plan(found, "executedPlan").count("Exchange ") == 1


def test_frequencies_come_from_one_pass(docs):
    found = retrieval.document_frequency(retrieval.postings(docs, ["title", "text"]))
    assert {(r.field, r.term): (r.df, r.cf) for r in found.collect()} == {("title", "t"): (2, 3), ("text", "alpha"): (1, 1), ("text", "beta"): (2, 4), ("text", "gamma"): (1, 1)}
    assert _plan(found).count("Generate") == 2


def test_texts_are_tokenised_once_for_pairs_and_labels(docs):
    assert _plan(docs.select(T.with_bigrams(T.tokens(F.col("text"), T.PLAIN_TOKEN)).alias("x"))).count("regexp_extract_all") == 1
    assert _plan(docs.select(T.label(F.col("text"))["label"].alias("x"))).count("regexp_extract(") == 2


def test_contents_are_matched_by_words_made_before_the_join(docs):
    entries = docs.select(F.lit("d").alias("doc_id"), F.lit(1).alias("ord"), F.col("text").alias("title"), F.lit("p").alias("page"))
    other = docs.select(F.lit("d").alias("doc_id"), F.lit(2).alias("ord"), "text", F.lit("p").alias("logical_page"))
    plan = _plan(structure.toc_matches(entries, other))
    assert plan.count("regexp_replace") == 2
