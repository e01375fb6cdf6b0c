import hashlib
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import clusters, queries


def brute(rows, size, k, rounds, scale=64):
    """Whole numbers of any size, one vector after another."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v)[1] == c] for c in range(len(centres))] if centres else []
        centres = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c for vs, c in zip(own, centres, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, c in found if c == x) for x in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], sum(sums), digest[c]) for i, d, c in found), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows, kind="long"):
    out = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>")
    return out.withColumns({c: F.lit("x") for c in ("point", "cluster", "n", "far", "total", "key", "distance", "inertia")})


@pytest.mark.parametrize(("size", "k", "rounds", "n"), [(4, 5, 3, 200), (3, 16, 4, 9), (2, 1, 2, 30), (64, 16, 0, 40)])
def test_against_brute_force(spark, size, k, rounds, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([rng.gauss(0, 1), rng.randrange(-2, 3) / 64, -0.0]) for _ in range(size)]) for i in range(n)]
    df = frame(spark, rows)
    want = brute(rows, size, k, rounds)
    for parts in (1, 7):
        assert got(clusters.lloyd(df.repartition(parts), size=size, k=k, rounds=rounds)) == want


def test_odd_vectors(spark):
    """Null, short, long, NaN and infinite ones go; null ids, repeated rows, ties and empty clusters have their results."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [1.0]), (4, [1.0, 2.0, 3.0]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [-inf, 0.0]), (8, [None, 1.0]), (9, []), (None, [0.25, 4.0]), (None, [0.25, 4.0]), (10, [-0.001, 0.001]), (2**60 + 1, [9.0, 9.0]), (11, [2e6, -2e6])]
    assert got(clusters.lloyd(frame(spark, rows).repartition(3), size=2, k=4, rounds=3)) == brute(rows, 2, 4, 3)
    same = [(i, [0.5, 0.25]) for i in range(20)]
    out = got(clusters.lloyd(frame(spark, same), size=2, k=4, rounds=2))
    assert out == brute(same, 2, 4, 2) and {r[1] for r in out} == {0}
    texts = [("a", [0.5, 0.25]), ("b", [1.5, 0.25]), (None, [0.5, 3.0])]
    assert got(clusters.lloyd(frame(spark, texts, "string"), size=2, k=2, rounds=2)) == brute(texts, 2, 2, 2)
    for nothing in (frame(spark, rows).limit(0), frame(spark, rows[2:6])):
        none = clusters.lloyd(nothing, size=2, k=4, rounds=3)
        assert none.count() == 0 and dict(none.dtypes)["vec_id"] == "bigint"


def test_sums_are_exact():
    import numpy as np

    big = np.full(5, (1 << 62) - 1, dtype=np.int64)
    assert clusters._sum(big) == 5 * ((1 << 62) - 1)


def test_too_large_numbers_are_refused(spark):
    with pytest.raises(Exception, match="no long holds"):
        clusters.lloyd(frame(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])]), size=2, k=2, rounds=1).collect()


def test_float_vectors_count_as_doubles(spark):
    rows = [(i, [i * 0.1, -i * 0.3]) for i in range(12)]
    single = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    exact = [(r.vec_id, list(r.embedding)) for r in single.collect()]
    assert got(clusters.lloyd(single, size=2, k=3, rounds=2)) == brute(exact, 2, 3, 2)


@pytest.mark.parametrize("name", ["op12_clusters", "op13_spelling"])
def test_query_against_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name]).fetchall()
    assert [d[0] for d in con.description] == df.columns
    assert got(df) == sorted(want, key=repr)
