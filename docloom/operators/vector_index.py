"""An index of vectors by their nearest centroid, for query tables.

Centroids come from rounds of Lloyd's method over a bounded sample; every vector is then stored in the list of its
nearest one, with the list's radius: how far its vectors are from the centroid. A query looks into the lists whose
centroids are most like it. That may miss neighbours; an exact search then also looks into every list that could still
hold one. With u the query and v a vector, both of length one (or zero), u.v is u.c + u.(v - c), which is at most
u.c + radius: lists for which this is under the k-th best score so far need no look.

Vectors of a list and the queries that look into it meet in groups of bounded size on both sides, one product each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.keys import KEY, key
from docloom.session import ship_package, stored
from docloom.sources.io import write_view

#: Vectors of the sample for each centroid, centroids at most, vectors and queries of a list that meet in one product.
PER_CENTROID, MOST_LISTS, VECTORS, QUERIES = 256, 4096, 4096, 512
#: Scores are sums of rounded products: two ways to compute one differ by less than this.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """Lists of vectors (key, ``role, embedding, list``), and the centroid, radius and size of each list."""

    lists: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def persist(self, path: str) -> None:
        """Write the index below a path, a folder a list; a rerun replaces it."""
        write_view(self.lists, f"{path}/lists", by="list")
        rows = [(i, self.centroids[i].tolist(), float(self.radii[i]), int(self.sizes[i])) for i in range(len(self.sizes))]
        write_view(self.lists.sparkSession.createDataFrame(rows, "list int, centroid array<double>, radius double, n long"), f"{path}/centroids")


def load(spark: SparkSession, path: str) -> VectorIndex:
    """A written index."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS
    return VectorIndex(spark.read.parquet(f"{path}/lists"), np.array([r.centroid for r in rows]), np.array([r.radius for r in rows]), np.array([r.n for r in rows]))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1))
    return m / np.where(length > 0, length, 1.0)[:, None]


def _nearest(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = (units * units).sum(axis=1)[:, None] - 2 * units @ centroids.T + (centroids * centroids).sum(axis=1)[None]
    found = far.argmin(axis=1)
    return found, np.sqrt(((units - centroids[found]) ** 2).sum(axis=1))


def _centroids(vectors: DataFrame, count: int, lists: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds over the vectors of smallest hashes, about PER_CENTROID for each list."""
    h = F.pmod(F.xxhash64(*key(vectors)), F.lit(1 << 20))
    share = min(1.0, PER_CENTROID * lists / max(1, count))
    sample = vectors.where(h < int(np.ceil(share * (1 << 20)))).select("embedding")
    first = vectors.select("embedding", F.xxhash64(*key(vectors)).alias("h")).orderBy("h", "embedding").limit(lists).collect()
    centroids = _unit(np.array([r.embedding for r in first], dtype=np.float64))
    size = centroids.shape[1]

    def sums(batches):
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                units = _unit(_matrix(batch.column(0)))
                found, _ = _nearest(units, centroids)
                np.add.at(total, found, units)
                n += np.bincount(found, minlength=len(n))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.float64()))], names=["list", "n", "total"])

    for _ in range(rounds):
        parts = sample.mapInArrow(sums, "list int, n long, total array<double>")
        merged = parts.groupBy("list").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(size))).alias("total"))
        for r in merged.collect():  # one row a list
            centroids[r.list] = np.array(r.total) / r.n
    return centroids


def build(vectors: DataFrame, *, lists: int | None = None, rounds: int = 6, id_col: str = "node_id", vector_col: str = "embedding", role_col: str = "role") -> VectorIndex:
    """An index of all vectors (``node_id``, with ``doc_id`` if there is one, ``role, embedding``).

    ``lists`` is by default the square root of the number of vectors, at most MOST_LISTS. Rows without a vector are
    left out; vectors have one length. Repeated rows and equal vectors are stored each. The lists are written to the
    shared folder; :meth:`VectorIndex.persist` puts them where they stay.
    """
    ship_package(vectors.sparkSession)
    own = [c for c in KEY[:-1] if c in vectors.columns]
    role = F.col(role_col) if role_col in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(*own, F.col(id_col).alias("node_id"), role.alias("role"), F.col(vector_col).cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    n = rows.count()
    if not n:
        return VectorIndex(rows.withColumn("list", F.lit(0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=np.int64))
    centroids = _centroids(rows, n, min(MOST_LISTS, lists or max(1, round(n**0.5))), rounds)
    names = [*rows.columns, "list", "far"]

    def placed(batches):
        for batch in batches:
            found, far = _nearest(_unit(_matrix(batch.column("embedding"))), centroids) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32)), pa.array(far)], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = stored(rows.mapInArrow(placed, f"{schema}, list int, far double"), "vector-lists")
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in out.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radii[r.list], sizes[r.list] = r.far, r.n
    return VectorIndex(out.drop("far"), centroids, radii, sizes)


def _looks(queries: DataFrame, index: VectorIndex, probes: int, *, after: bool = False) -> DataFrame:
    """``query_id, q, list``: the ``probes`` lists most like each query or, after them, those that can hold a score of ``least``."""
    centroids, radii, there = index.centroids, index.radii, index.sizes > 0
    probes = min(probes, int(there.sum()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            like = _unit(_matrix(batch.column("q"))) @ centroids.T
            like[:, ~there] = -np.inf
            first = np.zeros(like.shape, dtype=bool)
            np.put_along_axis(first, np.argsort(-like, axis=1, kind="stable")[:, :probes], True, axis=1)
            if after:
                least = np.asarray(batch.column("least"), dtype=np.float64)
                i, j = np.nonzero(~first & there[None] & (like + radii[None] + SLACK >= least[:, None]))
            else:
                i, j = np.nonzero(first)
            taken = batch.select(["query_id", "q"]).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(j.astype(np.int32))], names=["query_id", "q", "list"])

    return queries.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, q array<double>, list int")


def _scored(looks: DataFrame, index: VectorIndex, k: int, own: list[str]) -> DataFrame:
    """The best k of each query in each group of vectors, with all ties of the last place."""
    spark = looks.sparkSession
    asked = {r.list: r.n for r in looks.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    parts = [(i, max(1, -(-int(n) // VECTORS)), max(1, -(-asked.get(i, 0) // QUERIES))) for i, n in enumerate(index.sizes) if i in asked]
    salts = F.broadcast(spark.createDataFrame(parts, "list int, v int, q int"))  # at most MOST_LISTS rows
    group = ["list", "vs", "qs"]
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    vectors = index.lists.join(salts, "list").select(*own, "role", "embedding", "list", F.pmod(F.xxhash64(*own), F.col("v")).cast("int").alias("vs"), each("q").alias("qs"))
    queries = looks.join(salts.withColumnRenamed("q", "qn"), "list").select("query_id", "q", "list", F.pmod(F.xxhash64("query_id"), F.col("qn")).cast("int").alias("qs"), each("v").alias("vs"))
    kinds = {f.name: f.dataType.simpleString() for f in index.lists.schema}

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            y = _matrix(right["embedding"])
            ny = np.sqrt((y * y).sum(axis=1)) + 1e-8
            for at in range(0, left.num_rows, QUERIES):
                part = left.slice(at, QUERIES)
                x = _matrix(part["q"])
                scores = np.round((x @ y.T) / ((np.sqrt((x * x).sum(axis=1)) + 1e-8)[:, None] * ny[None]), 9) + 0.0
                most = min(k, len(y))
                i, j = np.nonzero(scores >= np.partition(scores, -most, axis=1)[:, -most][:, None])
                found.append(pa.table({"query_id": part["query_id"].take(pa.array(i)), **{c: right[c].take(pa.array(j)) for c in (*own, "role")}, "score": pa.array(scores[i, j])}))
        if not found:
            return pa.table({"query_id": left["query_id"].slice(0, 0), **{c: right[c].slice(0, 0) for c in (*own, "role")}, "score": pa.array([], pa.float64())})
        return pa.concat_tables(found)

    schema = ", ".join([f"query_id {looks.schema['query_id'].dataType.simpleString()}", *(f"{c} {kinds[c]}" for c in (*own, "role")), "score double"])
    return queries.groupBy(*group).cogroup(vectors.groupBy(*group)).applyInArrow(best, schema)


def _top(found: DataFrame, k: int, own: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *own))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search(index: VectorIndex, queries: DataFrame, *, k: int = 20, probes: int = 8, exact: bool = False, query_col: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """Top k by cosine for every row of ``queries`` (query_id, embedding): ``query_id``, the key, ``role, score``.

    The ``probes`` lists most like a query are looked into; with ``exact``, so are all that could hold a better one than
    the k-th found, and the result is that of :func:`docloom.operators.retrieval.nearest`. Scores have nine decimals,
    ties go to the smaller key. Queries without a vector have no hits; query ids are distinct.
    """
    ship_package(queries.sparkSession)
    own = key(index.lists)
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q")).where("q IS NOT NULL")
    kinds = dict(index.lists.dtypes)
    if not len(index.sizes):
        return queries.sparkSession.createDataFrame([], ", ".join([f"query_id {dict(asked.dtypes)['query_id']}", *(f"{c} {kinds[c]}" for c in (*own, "role")), "score double"]))
    looks = stored(_looks(asked, index, probes), "looks")
    found = _top(_scored(looks, index, k, own), k, own)
    if not exact:
        return found
    found = stored(found, "probed")
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    further = stored(_looks(asked.join(least, "query_id"), index, probes, after=True), "further-looks")
    return _top(found.unionByName(_scored(further, index, k, own)), k, own)


def scored_pairs(index: VectorIndex, queries: DataFrame, *, probes: int = 8, vector_col: str = "embedding") -> int:
    """How many pairs of a query and a vector the probes of a query table compare."""
    asked = queries.select("query_id", F.col(vector_col).cast("array<double>").alias("q")).where("q IS NOT NULL")
    return sum(int(index.sizes[r.list]) * r.n for r in _looks(asked, index, probes).groupBy("list").agg(F.count("*").alias("n")).collect())
