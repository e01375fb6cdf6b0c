import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language_id
from docloom.llm.queries import op2_language_id
from tests.llm.conftest import make_docs


def test_held_out_accuracy(spark):
    rows = op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 250 < len(test) < 420
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_labels_of_the_fold_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    a, b = (language_id.predict(d, language_id.fit(d.where(~language_id.held_out(F.col("doc_id"))))).orderBy("doc_id").collect() for d in (docs, other))
    assert a == b


def test_odd_rows(odd, empty):
    model = language_id.fit(odd)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()]
    assert len(got) == 12 and {r[0] for r in got if r[1] == "und"} == {3, 4, 5, 8}
    assert all(s == 0 for _, p, s in got if p == "und")
    kept = language_id.keep_determined(odd, model)
    assert kept.columns == odd.columns and kept.count() == 8
    predicted = {r[0]: r[1] for r in got}
    assert {r.lang for r in kept.collect() if r.doc_id == 7} == {predicted[7]}  # its own is null
    assert all(r.lang is not None for r in kept.collect())
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def grams(text, n):
    """N-grams of a text as a set, with the same folding but no bins."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    return {folded[i : i + n] for i in range(len(folded) - n + 1)}


def kernel(a, b):
    parts = [(grams(a, n), grams(b, n)) for n in range(1, 5)]
    return sum(len(x & y) / max(1, (len(x) * len(y)) ** 0.5) for x, y in parts) / 4


def some(spark, n):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 20").orderBy("doc_id").limit(4 * n).collect()
    return [(r.text[: language_id.PIECE // 2], r.lang) for r in rows[::4]]


def test_kernel_without_bins(spark):
    """The feature product against set kernels, and the folded matrix against kernel ridge regression on them."""
    rows = some(spark, 48)
    texts, labels = [t for t, _ in rows], [k for _, k in rows]
    x = language_id.presences([np.frombuffer(t.encode(), dtype=np.uint8) for t in texts])
    exact = np.array([[kernel(a, b) for b in texts] for a in texts])
    assert np.abs(x @ x.T - exact).max() < 0.05
    model = language_id.KernelModel.fit(texts, labels)
    names = model.languages
    assert len(texts) <= language_id.LANDMARKS_PER_LANGUAGE  # every text is a landmark, so Nystroem loses nothing
    y = np.array([[1.0 if k == label else -1.0 for k in names] for label in labels])
    share = np.array([1 / labels.count(k) for k in labels])
    weight = np.diag(share * len(labels) / share.sum())
    values, vectors = np.linalg.eigh(exact + 1e-6 * np.eye(len(texts)))
    root = vectors / np.sqrt(np.maximum(values, 1e-9)) @ vectors.T
    phi = exact @ root
    w = root @ np.linalg.solve(phi.T @ weight @ phi + language_id.RIDGE * np.eye(len(texts)), phi.T @ weight @ y)
    fresh = [t for t, _ in some(spark, 96)[48:]]
    want = np.array([[kernel(a, b) for b in texts] for a in fresh]) @ w
    got = model.values([np.frombuffer(t.encode(), dtype=np.uint8) for t in fresh])
    assert (want.argmax(axis=1) == got.argmax(axis=1)).mean() > 0.95
    assert np.abs(want - got).mean() < 0.1


def test_very_long_texts(spark):
    """A million characters of one language are told as well as a page."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = language_id.fit(rows.where(~language_id.held_out(F.col("doc_id"))))
    held = rows.where(language_id.held_out(F.col("doc_id"))).select("lang", "text").collect()
    for lang in {r.lang for r in held}:
        page = " ".join(r.text for r in held if r.lang == lang and r.text)
        raw = np.frombuffer((page * (1 + 1_000_000 // len(page))).encode(), dtype=np.uint8)
        assert model.languages[model.score([raw])[0][0]] == lang


def test_one_language_only(spark):
    docs = make_docs(spark, [(i, f"some words {i}", "en", "a") for i in range(5)])
    rows = language_id.predict(docs, language_id.fit(docs)).collect()
    assert {r.lang_pred for r in rows} == {"en"} and all(r.score == 1 for r in rows)
