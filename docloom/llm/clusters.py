"""Lloyd's clustering of integer vectors.

Every round broadcasts the centroids, a few short rows of numbers whose count is a parameter. ``mapInPandas`` takes
a batch's squared differences from each centroid in NumPy, gives every vector the lowest index of the least distance,
and returns one row of sums a cluster and partition; ``groupBy`` merges these rows. All numbers are integers, so a
result is the same in any order of rows and for any number of partitions, and a lost task is simply computed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import ship_package

#: Components may be this large in size: the squared distance of two vectors of 64 of them is a long.
LARGEST = 1 << 27
#: Vectors compared with all centroids at once.
BLOCK = 4096


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, none of them null, NaN or infinite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(x) == size) & finite, F.lit(False))


def scaled(vector: Column, scale: int = 64) -> Column:
    """Each component, as a double, to the integer ``floor(scale * x)``."""
    return F.transform(vector.cast("array<double>"), lambda v: F.floor(v * scale))


def first_centroids(vectors: DataFrame, k: int, key: Column) -> np.ndarray:
    """The ``k`` vectors (all, if there are fewer) of smallest key, in its order; equal keys go by their components."""
    rows = vectors.select(key.alias("key"), "point").orderBy(F.col("key").asc_nulls_last(), "point").limit(k).collect()
    return np.array([r.point for r in rows], dtype=np.int64)


def _points(column: pd.Series) -> np.ndarray:
    points = np.stack(column.to_numpy()).astype(np.int64, copy=False)
    if points.size and max(-int(points.min()), int(points.max())) > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST}: no long holds its squared distance")
    return points


def _sum(numbers: np.ndarray) -> int:
    """The exact sum of longs that are not negative."""
    return (int((numbers >> 32).sum()) << 32) + int((numbers & 0xFFFFFFFF).sum())


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number and squared distance of each point's nearest centroid; ties go to the smaller number."""
    cluster, least = np.empty(len(points), dtype=np.int32), np.empty(len(points), dtype=np.int64)
    for a in range(0, len(points), BLOCK):
        part = points[a : a + BLOCK]
        far = np.empty((len(part), len(centroids)), dtype=np.int64)
        for c, centre in enumerate(centroids):
            d = part - centre
            far[:, c] = np.einsum("ij,ij->i", d, d)
        cluster[a : a + BLOCK] = far.argmin(axis=1)
        least[a : a + BLOCK] = far.min(axis=1)
    return cluster, least


def _totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that has vectors: their number, the sum of their distances, and their sum, componentwise."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, size = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, far, total = [0] * k, [0] * k, [[0] * size for _ in range(k)]
        for batch in batches:
            if not len(batch):
                continue
            points = _points(batch["point"])
            cluster, distance = nearest(points, shared.value)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                count[c] += int(own.sum())
                far[c] += _sum(distance[own])
                total[c] = [a + b for a, b in zip(total[c], points[own].sum(axis=0).tolist(), strict=True)]
        rows = [(c, count[c], str(far[c]), list(map(str, total[c]))) for c in range(k) if count[c]]
        yield pd.DataFrame(rows, columns=["cluster", "n", "far", "total"])

    parts = vectors.select("point").mapInPandas(sums, "cluster int, n long, far string, total array<string>")
    whole = T.DecimalType(38, 0)
    merged = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum(F.col("far").cast(whole)).cast("string").alias("far"), F.array(*(F.sum(F.col("total")[i].cast(whole)).cast("string") for i in range(size))).alias("total")
    )
    found = {r.cluster: (r.n, int(r.far), list(map(int, r.total))) for r in merged.collect()}  # at most k rows
    shared.destroy()
    return found


def lloyd(vectors: DataFrame, *, size: int, k: int, rounds: int, scale: int = 64, key: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` after ``rounds`` of Lloyd's method.

    Vectors that are not :func:`usable` (null, of another length than ``size``, or with a null, NaN or infinite
    component) are left out; the others are :func:`scaled` to integers. The centroids start as the ``k`` vectors of
    smallest ``key`` (by default the SHA-256 of ``1:`` and the id). Every round gives each vector to the nearest
    centroid and moves each centroid that has vectors to the floor of their mean; then vectors are given out once more.
    ``distance`` is squared, the inertias are its sums over the cluster and over all, and the digest is that of the
    final centroid's numbers, joined by commas.

    A null id counts as the text ``null`` in the key. Repeated rows are vectors of their own, and equal vectors may be
    several centroids, of which the lowest has all their vectors. With fewer vectors than ``k`` there are fewer
    centroids; an empty table gives an empty result. Integers above LARGEST in size are refused with an error. Other
    columns are not read. The table is read once for the first centroids, once a round and twice more, for the inertias
    and the result; only ``k`` rows of sums ever reach the driver.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[id_col].dataType
    vector = F.col(vector_col)
    # ids travel as text, since pandas turns whole numbers with nulls into floating ones
    vectors = vectors.where(usable(vector, size)).select(F.col(id_col).cast("string").alias("vec_id"), scaled(vector, scale).alias("point"))
    form = "vec_id string, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if key is None:
        key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id"), F.lit("null"))), 256)
    centroids = first_centroids(vectors, k, key)
    if not len(centroids):
        return spark.createDataFrame([], form).withColumn("vec_id", F.col("vec_id").cast(kind))
    for _ in range(rounds):
        for c, (n, _far, total) in _totals(vectors, centroids).items():
            centroids[c] = [t // n for t in total]
    inertias = {c: far for c, (_, far, _total) in _totals(vectors, centroids).items()}
    whole = sum(inertias.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def given(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, distance = nearest(_points(batch["point"]), centroids) if len(batch) else (np.empty(0, np.int32), np.empty(0, np.int64))
            found = cluster.tolist()
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": cluster, "distance": distance, "cluster_inertia": [inertias[c] for c in found], "inertia": whole, "centroid_sha256": [digests[c] for c in found]})

    return vectors.mapInPandas(given, form).withColumn("vec_id", F.col("vec_id").cast(kind))
