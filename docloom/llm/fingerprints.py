"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k smallest distinct shingle hashes (48 bits each). The sketch of a union is made of
the sketches of its parts, so parts of a text, or shards of a corpus, can be sketched apart and merged.
Two sketches estimate resemblance and containment, one the number of distinct shingles.

As text, a sketch is Base64 of its hashes in ascending order, six bytes each, big-endian.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ship_package
from docloom.llm.shingles import BLOCK, shingle_hashes

#: Hashes in a sketch, words in a shingle.
K, WORDS = 64, 5
BITS = 48


class Sketch:
    """The smallest distinct hashes of a set, ascending; complete if fewer than k."""

    def __init__(self, hashes: np.ndarray, k: int = K):
        self.hashes, self.k = hashes, k

    @classmethod
    def of_hashes(cls, hashes: np.ndarray, k: int = K) -> Sketch:
        return cls(np.unique(hashes >> np.uint64(64 - BITS))[:k], k)

    @classmethod
    def of_text(cls, text: str, k: int = K, words: int = WORDS) -> Sketch:
        data = np.frombuffer(text.encode() + b" ", dtype=np.uint8)
        return cls.of_hashes(shingle_hashes(np.array([0, len(data)]), data, words)[0], k)

    @classmethod
    def from_string(cls, s: str, k: int = K) -> Sketch:
        raw = np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, BITS // 8).astype(np.uint64)
        return cls(reduce(lambda a, i: (a << np.uint64(8)) | raw[:, i], range(BITS // 8), np.zeros(len(raw), dtype=np.uint64)), k)

    def __str__(self) -> str:
        return base64.b64encode(self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()

    def merge(self, other: Sketch) -> Sketch:
        k = min(self.k, other.k)
        return Sketch(np.union1d(self.hashes, other.hashes)[:k], k)

    def distinct(self) -> float:
        """Estimated number of distinct shingles; exact below k."""
        if len(self.hashes) < self.k:
            return float(len(self.hashes))
        return (self.k - 1) / (float(self.hashes[-1]) / 2.0**BITS)

    def resemblance(self, other: Sketch) -> float:
        """Estimated Jaccard similarity: the share of both in the union's sketch. Two empty sets are alike."""
        union = self.merge(other).hashes
        if not len(union):
            return 1.0
        both = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float((both <= union[-1]).sum()) / len(union)

    def containment(self, other: Sketch) -> float:
        """Estimated share of this set's shingles that the other set has; 1 for an empty set."""
        own = self.distinct()
        return min(1.0, self.resemblance(other) * self.merge(other).distinct() / own) if own else 1.0


def fingerprint_pairs(docs: DataFrame, *, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and likenesses to the next document.

    The edited text replaces the last floor(n / 2) code points by the first as many, or all, of the
    next document in ascending doc_id (after the last: the first; null ids come first, rows with one
    id are ordered by text). Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, distinct, contained``: likenesses are estimated resemblances, ``distinct``
    the estimated number of shingles, ``contained`` how much of the document its edited text holds. A
    null text counts as empty; the sketch of a text without words is empty, as its string, and like
    only another empty one. Ids are whole numbers. A lone document follows itself. An empty table gives an empty result.

    The documents are cut into id ranges of about equal size. Each range also gets the first document
    of the next one, so neighbours always meet, and a task streams through its range in order: it
    holds two texts and a block at a time.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = rows.select("key")
    bounds = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], min(100 * n, 200_000))).head()[0] or []
    bounds = sorted(set(bounds))
    part = _range_of(F.col("key"), bounds)
    firsts = dict(sorted(tuple(r) for r in keys.groupBy(part.alias("part")).agg(F.min("key")).collect()))  # one row a range
    parts = list(firsts)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    spread = lambda known: _numbers([known.get(p) for p in range(max(parts, default=-1) + 1)])
    placed = rows.withColumn("part", part)
    own, tail = F.struct("part", F.lit(0).alias("tail")), F.struct(F.get(spread(before), F.col("part")).cast("int").alias("part"), F.lit(1).alias("tail"))
    sent = F.when(F.get(spread(firsts), F.col("part")) == F.col("key"), F.array(own, tail)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "key", "text", F.explode(sent).alias("to")).select("doc_id", "key", "text", "to.part", "to.tail")
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "tail", "key", "text").select("doc_id", "text", "tail")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct double, contained double"

    def run(batches):
        last = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                stop, size = at, 0
                while stop < len(rows) and (stop == at or size < BLOCK):
                    size += len(rows[stop][1])
                    stop += 1
                group = rows[at:stop] if last is None else [last, *rows[at:stop]]
                if out := _sketched(group, k, words):
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, batch.schema.field(0).type) for i, c in enumerate(zip(*out, strict=True))], names=names)
                last, at = rows[stop - 1], stop

    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
    return dealt.mapInArrow(run, f"doc_id {kind}, {schema}")


def _numbers(values: list) -> Column:
    """A list of whole numbers or nulls as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), F.lit("array<bigint>"))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below a key, found in two steps of about sqrt(bounds) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = _numbers([g[-1] for g in groups])
    lists = F.from_json(F.lit(json.dumps(groups)), F.lit("array<array<bigint>>"))
    group = F.size(F.filter(tops, lambda t: t < key))
    inside = F.coalesce(F.size(F.filter(F.get(lists, group), lambda b: b < key)), F.lit(0))
    return (group * step + F.when(group < len(groups), inside).otherwise(0)).cast("int")


def _sketched(group: list[tuple], k: int, words: int) -> list[tuple]:
    """Result rows of all but the last of consecutive (doc_id, text, tail) rows; tails only follow."""
    if len(group) < 2:
        return []
    texts = [t for _, t, _ in group]
    edited = []
    for own, following in zip(texts, texts[1:], strict=False):
        half = len(own) // 2
        edited.append((own[: len(own) - half] + following[:half]).encode())
    sketches = _sketch_all([t.encode() for t in texts] + edited, k, words)
    own, other = sketches[: len(texts)], sketches[len(texts) :]
    out = []
    for i, (doc, text, tail) in enumerate(group[:-1]):
        if not tail:
            a, b = own[i], other[i]
            out.append((doc, len(text), hashlib.sha256(edited[i]).hexdigest(), str(a), str(b), a.resemblance(b), a.resemblance(own[i + 1]), a.distinct(), a.containment(b)))
    return out


def _sketch_all(texts: list[bytes], k: int, words: int) -> list[Sketch]:
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hashes, begin = shingle_hashes(offsets, data, words)
    return [Sketch.of_hashes(hashes[a:b], k) for a, b in zip(begin[:-1], begin[1:], strict=True)]
