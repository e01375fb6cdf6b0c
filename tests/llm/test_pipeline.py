import random

import corpus_pipeline
from docloom.llm import language_id
from tests.llm.conftest import make_docs, words
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_near_dedup import edited


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        base = words(rng, 60, 10**6)
        rows.append((4 * i, base, "en", "abc"[i % 3]))
        rows.append((4 * i + 1, base.replace(" ", "  ", 3), "en", "a"))
        rows.append((4 * i + 2, edited(rng, base, 1), "en", "b"))
        rows.append((4 * i + 3, rng.choice(["123 !!", "", None, words(rng, 30, 10**6)]), "en", None))
    docs = make_docs(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "near dedup", "mixing", "BPE"]

    first = stages["language ID"](spark, docs, sf)
    assert first.columns == docs.columns
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert rows_of(first) == sorted((r[0], r[1]) for r in letters)

    second = stages["exact dedup"](spark, first, sf)
    kept = {d for d, _, _, k, _ in exact_brute(letters) if k}
    assert {r[0] for r in rows_of(second)} == kept and second.columns == docs.columns

    third = stages["near dedup"](spark, second, sf)
    left = [r for r in letters if r[0] in kept]
    stays = {d for d, _, _, k in near_brute(left, 5) if k}
    assert {r[0] for r in rows_of(third)} == stays and third.columns == docs.columns

    fourth = stages["mixing"](spark, third, sf)
    assert fourth.columns == docs.columns
    times = [r[0] for r in rows_of(fourth)]
    assert set(times) <= stays and max(times.count(d) for d in set(times)) <= 2

    last = stages["BPE"](spark, fourth, sf).collect()
    assert sorted(r.doc_id for r in last) == times
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in whole) == sorted((r.doc_id, r.decoded_sha256) for r in last)


def test_a_corpus_without_labels_keeps_its_documents(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, t, None, "a") for i, t in enumerate([words(rng, 40, 10**6), words(rng, 50, 10**6), "", None, "12 !!", "É"])]
    docs = make_docs(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and sorted(map(str, first.collect())) == sorted(map(str, docs.where("doc_id IN (0, 1, 5)").collect()))
    assert {0, 1} <= {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.language(spark, docs, "/root/testdata/sf0.001")
    assert out.count() == docs.where("text rlike '\\\\p{L}'").count()
    assert language_id.UNDETERMINED == "und"
