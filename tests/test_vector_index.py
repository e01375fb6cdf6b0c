import numpy as np
import pytest

from docloom.operators import retrieval, vector_index
from docloom.plans.ports import ListBackend


def rows(df):
    return sorted((r.query_id, round(-r.score, 9), r.node_id, r.role) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    """4000 vectors around 60 places, some equal, one of zeros, a third of them at one place; every 40th is a query."""
    rng = np.random.default_rng(4)
    places = rng.normal(size=(60, 16))
    m = places[np.where(rng.random(4000) < 0.3, 0, rng.integers(0, 60, 4000))] + 0.3 * rng.normal(size=(4000, 16))
    m[7], m[100:130] = 0.0, m[99]
    vectors = spark.createDataFrame([(f"v{i}", i % 3, row.tolist()) for i, row in enumerate(m)], "node_id string, role int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 4000, 40)] + [(-1, [0.0] * 16)], "query_id long, embedding array<double>")
    return vectors, queries, vector_index.build(vectors, lists=48)


def test_exact_search_is_that_of_all_pairs(spark, clustered, monkeypatch):
    vectors, queries, built = clustered
    want = rows(retrieval.nearest(vectors, queries, k=15))
    assert rows(vector_index.search(built, queries, k=15, probes=2, exact=True)) == want
    monkeypatch.setattr(vector_index, "VECTORS", 100)  # groups of a few vectors and queries: the same
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    assert rows(vector_index.search(built, queries, k=15, probes=3, exact=True)) == want


def test_recall_and_work_of_probes(clustered):
    vectors, queries, built = clustered
    want = {(q, n) for q, _, n, _ in rows(retrieval.nearest(vectors, queries, k=10)) if q >= 0}
    got = {(q, n) for q, _, n, _ in rows(vector_index.search(built, queries, k=10, probes=6))}
    assert len(want & got) / len(want) >= 0.9
    assert vector_index.scored_pairs(built, queries, probes=6) < 0.6 * 4000 * queries.count()
    assert built.sizes.sum() == 4000


def test_given_vectors_reach_recall(spark):
    """The given vectors have hardly any clusters: recall at 100 of 0.9 takes 19 of 22 lists; exact search needs no luck."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("concat('v', vec_id) AS node_id", "label AS role", "embedding", "vec_id")
    queries = v.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding")
    built = vector_index.build(v, lists=22)
    exact = rows(retrieval.nearest(v, queries, k=100))
    want = {(q, n) for q, _, n, _ in exact}
    got = {(q, n) for q, _, n, _ in rows(vector_index.search(built, queries, k=100, probes=19))}
    assert len(want & got) / len(want) >= 0.9
    assert rows(vector_index.search(built, queries, k=100, probes=2, exact=True)) == exact


def test_written_index_and_keys_of_documents(spark, clustered, tmp_path):
    vectors, queries, _ = clustered
    twice = vectors.selectExpr("'a' AS doc_id", "*").unionByName(vectors.selectExpr("'b' AS doc_id", "*"))
    vector_index.build(twice, lists=10, rounds=1).persist(f"{tmp_path}/i")
    found = vector_index.search(vector_index.load(spark, f"{tmp_path}/i"), queries.where("query_id = 400"), k=4, exact=True).collect()
    assert len(found) == 4 and len({(r.doc_id, r.node_id) for r in found}) == 4
    assert {r.doc_id for r in found} == {"a", "b"}


def test_empty_and_odd_tables(spark, clustered):
    vectors, queries, built = clustered
    none = vector_index.build(vectors.limit(0))
    assert vector_index.search(none, queries).count() == 0 and vector_index.search(built, queries.limit(0), exact=True).count() == 0
    few = vector_index.build(vectors.where("node_id IN ('v1', 'v2')").unionByName(spark.createDataFrame([("n", 1, None)], vectors.schema)))
    assert sorted(r.node_id for r in vector_index.search(few, queries.where("query_id = 0"), k=9, exact=True).collect()) == ["v1", "v2"]


def test_back_end(spark, tmp_path):
    texts = spark.createDataFrame([("a", "cats and dogs"), ("b", "birds in trees"), ("c", "fish")], "node_id string, text string")
    made = ListBackend(exact=True).build(texts)
    made.persist(f"{tmp_path}/b")
    for backend in (made, ListBackend(exact=True).load(spark, f"{tmp_path}/b")):
        assert backend.search("birds in trees", k=1).collect()[0].node_id == "b"
