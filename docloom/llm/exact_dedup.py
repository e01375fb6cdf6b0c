"""Exact deduplication with a distributed cuckoo-filter index of live digests.

A text's key is the SHA-256 of its white-space normalised form. Keys are dealt to index partitions by
their value; each partition holds a cuckoo filter (short fingerprints, two possible buckets a key)
beside the full keys, which are kept by bucket. A filter miss proves a key new; a hit is verified
against the keys of its bucket. When no slot can be freed, the table doubles and is filled again from
the stored keys. Keys can also be deleted, so an index follows a corpus that changes.

Only digests and ids move between machines. Each input batch is reduced to one row per digest before
the exchange, so a text with any number of copies costs the index at most one row per batch.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, materialise, ship_package

SLOTS = 4
KICKS = 200
#: Rows for which an index partition is meant; more rows make more partitions.
ROWS_PER_INDEX = 200_000


class CuckooIndex:
    """Set of byte keys with a record each: insert, find and delete in constant time."""

    def __init__(self, buckets: int = 1024):
        self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * SLOTS * buckets))
        self.content: list[list | None] = [None] * buckets
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets; the second follows from the first and the fingerprint."""
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _has(self, bucket: int, mark: int) -> bool:
        at = bucket * SLOTS
        return mark in self.slots[at : at + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[at]:
                self.slots[at] = mark
                return True
        return False

    def find(self, key: bytes) -> list | None:
        """The record of a live key, else None. Filter hits are verified against the stored keys."""
        mark, first, second = self._places(key)
        if self._has(first, mark) or self._has(second, mark):
            for record in self.content[first] or ():
                if record[0] == key:
                    return record
        return None

    def insert(self, key: bytes, *values) -> list:
        """Add a key that is not live and return its record, ``[key, *values]``."""
        record = [key, *values]
        while not self._place(key):
            self._grow()
        first = self._places(key)[1]
        if self.content[first] is None:
            self.content[first] = []
        self.content[first].append(record)
        self.size += 1
        return record

    def _place(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        if self._put(first, mark) or self._put(second, mark):
            return True
        bucket, moves = second, []
        for kick in range(KICKS):
            at = bucket * SLOTS + kick % SLOTS
            moves.append((at, self.slots[at]))
            mark, self.slots[at] = self.slots[at], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        for at, old in reversed(moves):
            self.slots[at] = old
        return False

    def _grow(self) -> None:
        records = list(self.records())
        self.resizes += 1
        buckets = 2 * (self.mask + 1)
        while True:
            self._empty(buckets)
            for record in records:
                if not self._place(record[0]):
                    break
                first = self._places(record[0])[1]
                if self.content[first] is None:
                    self.content[first] = []
                self.content[first].append(record)
                self.size += 1
            else:
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        """Remove a live key; False if there is none."""
        record = self.find(key)
        if record is None:
            return False
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[at] == mark:
                    self.slots[at] = 0
                    self.content[first].remove(record)
                    self.size -= 1
                    return True
        raise AssertionError("a live key has a slot")

    def records(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket or ()


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest``: the SHA-256 of each normalised text as 32 bytes."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def build_index(rows: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``digest, keep_id, group_size`` of the live digests in ``rows`` (doc_id, digest).

    keep_id is the smallest doc_id; null ids count after all others. ``removed`` (digest) lists digests
    to delete after the insertions. ``rows`` is counted first, so it should be a written table.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_INDEX))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def combine(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.group_by("digest").aggregate([("doc_id", "min"), ("n", "sum"), ("gone", "max")])
            t = t.select(["digest", "doc_id_min", "n_sum", "gone_max"]).rename_columns(["digest", "doc_id", "n", "gone"])
            yield from t.to_batches()

    def index(batches):
        live, gone = CuckooIndex(), []
        for batch in batches:
            for key, doc, n, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out:
                    gone.append(key)
                if not n:
                    continue
                record = live.find(key)
                if record is None:
                    live.insert(key, doc, n)
                else:
                    if doc is not None and (record[1] is None or doc < record[1]):
                        record[1] = doc
                    record[2] += n
        for key in gone:
            live.delete(key)
        part = []
        for record in live.records():
            part.append(record)
            if len(part) == 10_000:
                yield _batch(part, schema)
                part = []
        yield _batch(part, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    schema = to_arrow_schema(StructType().add("digest", "binary").add("keep_id", rows.schema["doc_id"].dataType).add("group_size", LongType()))
    ops = rows.select("digest", "doc_id", F.lit(1).cast("long").alias("n"), F.lit(0).alias("gone"))
    if removed is not None:
        ops = ops.unionByName(removed.select("digest", F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("gone")))
    ship_package(rows.sparkSession)
    dealt = ops.mapInArrow(combine, f"digest binary, doc_id {kind}, n long, gone int").repartition(parts, "digest")
    return dealt.mapInArrow(index, f"digest binary, keep_id {kind}, group_size long")


def _batch(records: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*records, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space is replaced by one space; null and
    empty texts are equal. The row with the smallest doc_id of equal texts stays (null ids last); rows
    that repeat a doc_id and a text count in group_size and share their result. An empty table gives
    an empty result; other columns of ``docs`` are not looked at.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    return rows.join(build_index(rows), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row for each normalised text.

    A document goes when an equal text has a smaller id (null ids last). Rows of one id and one text count as
    copies too: of those that would all stay, the one with the smallest hash of all its columns does (any one
    of several equal rows). An empty table gives an empty result.

    Decisions are made on digests and ids. The documents themselves then meet only the ids that go, in one merge
    join at every size, and the keys that several rows share, if there are any.
    """
    digest, key_id = "__docloom_digest", "__docloom_id"
    judged = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    rows = materialise(digests(docs, id_col, text_col), "digests")
    groups = materialise(build_index(rows).where("group_size > 1"), "digest-groups")
    copies = rows.join(groups, "digest").groupBy("digest", "doc_id").agg(F.first("keep_id").alias("keep_id"), F.count("*").alias("n"))
    goes = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    copies = materialise(copies.where(goes | (F.col("n") > 1)).select(F.col("digest").alias(digest), F.col("doc_id").alias(key_id), goes.alias("goes")), "digest-copies")

    def same(keys: DataFrame):
        return (judged[digest] == keys[digest]) & judged[id_col].eqNullSafe(keys[key_id])

    alone = judged.join(copies.hint("merge"), same(copies), "left_anti").select(*docs.columns)
    twins = copies.where("not goes")
    if not twins.limit(1).count():
        return alone
    shared = judged.join(twins.hint("merge"), same(twins), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = shared.groupBy(digest, F.col(id_col).alias(key_id)).agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))).alias("__docloom_row"))
    return alone.unionByName(one.select("__docloom_row.*"))
