"""What a retrieval back end has to offer, and those that come with the package."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import index, retrieval, vector_index
from docloom.sources.io import write_view


@runtime_checkable
class Retrieval(Protocol):
    """Anything that finds nodes for a query: ``node_id, score``, best first."""

    def search(self, query: str, *, k: int = 20) -> DataFrame: ...


class Backend(ABC):
    """An index over texts (node_id, text, ...): built from a table, written, loaded and asked."""

    @abstractmethod
    def build(self, rows: DataFrame) -> Backend:
        """An index of all rows."""

    @abstractmethod
    def search(self, query: str, *, k: int = 20) -> DataFrame:
        """The top k for a query."""

    @abstractmethod
    def persist(self, path: str) -> None:
        """Write the index below a path; a rerun replaces it."""

    @abstractmethod
    def load(self, spark: SparkSession, path: str) -> Backend:
        """A written index."""


class KeywordBackend(Backend):
    """BM25F over posting lists."""

    def __init__(self, fields: tuple[str, ...] = ("text",)):
        self.fields, self.lists, self.stats = fields, None, None

    def build(self, rows: DataFrame) -> KeywordBackend:
        self.lists, self.stats = retrieval.posting_lists(rows, list(self.fields))
        return self

    def search(self, query: str, *, k: int = 20) -> DataFrame:
        return retrieval.bm25f_lists(self.lists, self.stats, query, weights=dict.fromkeys(self.fields, 1.0), k=k)

    def persist(self, path: str) -> None:
        write_view(self.lists, f"{path}/lists", by="field")
        write_view(self.stats, f"{path}/stats")

    def load(self, spark: SparkSession, path: str) -> KeywordBackend:
        self.lists, self.stats = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/stats")
        return self


class VectorBackend(Backend):
    """Cosine over vectors of an encoder, by default the hashed bag of words."""

    def __init__(self, encode: Callable[[list[str]], list[list[float]]] | None = None):
        self.encode, self.vectors = encode, None

    def build(self, rows: DataFrame) -> VectorBackend:
        named = rows.select("node_id", F.lit(None).cast("string").alias("role"), F.col("text").alias("dense_text"))
        self.vectors = index.dense_view(named, self.encode)
        return self

    def search(self, query: str, *, k: int = 20) -> DataFrame:
        return retrieval.dense(self.vectors, index.encode_query(self.vectors.sparkSession, query, self.encode), k=k).select("node_id", "score")

    def persist(self, path: str) -> None:
        write_view(self.vectors, f"{path}/vectors")

    def load(self, spark: SparkSession, path: str) -> VectorBackend:
        self.vectors = spark.read.parquet(f"{path}/vectors")
        return self


class ListBackend(VectorBackend):
    """Cosine over lists of vectors by centroid: the ``probes`` lists most like a query, or all that can hold a hit."""

    def __init__(self, encode: Callable[[list[str]], list[list[float]]] | None = None, *, probes: int = 8, exact: bool = False):
        super().__init__(encode)
        self.probes, self.exact, self.index = probes, exact, None

    def build(self, rows: DataFrame) -> ListBackend:
        super().build(rows)
        self.index = vector_index.build(self.vectors)
        return self

    def search(self, query: str, *, k: int = 20) -> DataFrame:
        spark = self.index.lists.sparkSession
        asked = spark.createDataFrame([(0, index.encode_query(spark, query, self.encode))], "query_id int, embedding array<double>")
        return self.search_all(asked, k=k).select("node_id", "score")

    def search_all(self, queries: DataFrame, *, k: int = 20) -> DataFrame:
        """The top k of every row of a query table (query_id, embedding)."""
        return vector_index.search(self.index, queries, k=k, probes=self.probes, exact=self.exact)

    def persist(self, path: str) -> None:
        self.index.persist(path)

    def load(self, spark: SparkSession, path: str) -> ListBackend:
        self.index = vector_index.load(spark, path)
        self.vectors = self.index.lists
        return self
