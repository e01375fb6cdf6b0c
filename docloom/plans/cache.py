"""Written results of named steps, keyed by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import stored


def signature(params: dict[str, Any], inputs: list[str] = (), version: str = "") -> str:
    """Ten hex digits of the parameters, the inputs' signatures and the operator's version."""
    return hashlib.sha256(json.dumps([params, list(inputs), version], sort_keys=True, default=str).encode()).hexdigest()[:10]


class StepCache:
    """Steps as Parquet folders ``root/name-signature``; a folder counts once Spark has committed it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load_or_compute(self, name: str, make: Callable[[], DataFrame], params: dict[str, Any], inputs: list[str] = (), *, version: str = "", force: bool = False, cache_only: bool = False) -> tuple[DataFrame, str]:
        """The step's rows and signature, computed if no committed folder has them."""
        sig = signature(params, inputs, version)
        path = f"{self.root}/{name}-{sig}"
        if force or not self._exists(f"{path}/_SUCCESS"):
            if cache_only:
                raise FileNotFoundError(path)
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), sig

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def memoised(requests: DataFrame, known: DataFrame, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers of ``requests`` (key, request): known ones (key, response) joined, others called for.

    Each distinct unknown request is called for once: the new answers are written before they are used, so that those
    joined and those returned, to append to the known table, are the same.
    """
    unknown = requests.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = stored(call(unknown), "memoised")
    return requests.join(known.unionByName(new), "key"), new


def request_key(*columns: str):
    """Key of a request: SHA-256 of its columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
