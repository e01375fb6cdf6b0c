import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import common, sharding
from docloom.llm.queries import op4_sharding
from tests.llm.conftest import make_docs, words


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    same = words(rng, 30)
    rows = [(i, same if i % 3 == 0 else words(rng, rng.randrange(40)), "en", "a") for i in range(1003)]
    return make_docs(spark, rows).repartition(4)


def test_shards_are_equal_and_gapless(docs):
    rows = sharding.shuffle_into_shards(docs, 8).collect()
    assert len(rows) == 1003 and len({r.doc_id for r in rows}) == 1003
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(8))
    assert {len(v) for v in by.values()} <= {125, 126}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sizes_and_crc(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in sharding.shuffle_into_shards(docs, 8).collect():
        raw = text[r.doc_id].encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)


def test_reruns_agree(docs):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(sharding.shuffle_into_shards(docs, 8)) == key(sharding.shuffle_into_shards(docs.repartition(1), 8))


def test_matrix_has_the_margins(spark):
    sizes = [5, 0, 17, 3, 40, 1, 1, 9]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "chunk long, n long")
    rows = sharding.communication_matrix(counts, 3, 3, "s").collect()
    cut = {r.chunk: [b - a for a, b in zip(r.starts, r.starts[1:])] for r in rows}
    assert [sum(cut[i]) for i in range(8)] == sizes
    assert sorted(sum(cut[i][s] for i in range(8)) for s in range(3)) == [25, 25, 26]


@pytest.mark.parametrize("total, marked, drawn", [(20, 7, 9), (500, 120, 80), (10, 10, 4), (9, 0, 5), (12, 5, 12), (1, 1, 1)])
def test_hypergeometric_inverts_the_distribution(spark, total, marked, drawn):
    lo, hi = max(0, drawn + marked - total), min(drawn, marked)
    weights = [math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) for k in range(lo, hi + 1)]
    n = 400
    u = (F.col("id") + 0.5) / n
    args = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    got = [r.k for r in spark.range(n).select(sharding.hypergeometric(*args, u).alias("k")).collect()]
    for i, k in enumerate(got):
        below = sum(weights[: k - lo])
        assert below - 1e-9 <= (i + 0.5) / n <= below + weights[k - lo] + 1e-9


def test_large_numbers_keep_to_the_law(spark):
    total, marked, drawn = 10_000_000_000, 1_250_000_000, 5_000_000_000
    args = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    u = F.element_at(F.array(*(F.lit(x) for x in (0.0013499, 0.5, 0.9986501))), (F.col("id") + 1).cast("int"))
    got = [r.k for r in spark.range(3).select(sharding.hypergeometric(*args, u).alias("k")).collect()]
    mean, sd = drawn * marked / total, math.sqrt(drawn * (marked / total) * (1 - marked / total) * (total - drawn) / (total - 1))
    assert [round((k - mean) / sd, 2) for k in got] == [-3.0, 0.0, 3.0]


def test_every_slot_is_as_likely(spark):
    docs = make_docs(spark, [(i, "x", "en", "a") for i in range(24)])
    seen = [0] * 4
    for seed in range(12):
        for r in sharding.shuffle_into_shards(docs, 4, seed=str(seed)).where("doc_id < 6").collect():
            seen[r.shard] += 1
    assert sum(seen) == 72 and all(6 <= n <= 32 for n in seen)


def test_whole_rows_move(docs, odd):
    """Every column of every row arrives, rows of one id included, at the slot that the digests have."""
    for given in (docs, odd):
        out = sharding.sharded(given, 5)
        assert out.schema["row"].dataType.names == given.columns
        rows = out.collect()
        assert sorted((tuple(r.row) for r in rows), key=repr) == sorted(map(tuple, given.collect()), key=repr)
        digests = {(r.shard, r.slot): (r.doc_id, r["size"], r.text_crc32) for r in sharding.shuffle_into_shards(given, 5).collect()}
        assert {(r.shard, r.slot): (r.row.doc_id, len((r.row.text or "").encode()) + 1, zlib.crc32((r.row.text or "").encode())) for r in rows} == digests


def test_odd_rows(odd, empty):
    rows = sharding.shuffle_into_shards(odd, 5).collect()
    assert len(rows) == 12 and {r["size"] for r in rows if r.doc_id in (3, 4)} == {1}
    assert sharding.shuffle_into_shards(empty, 8).count() == 0


def h32(key, salt):
    return int(hashlib.md5((salt + ("null" if key is None else str(key))).encode()).hexdigest()[:8], 16)


def test_query_against_a_sequential_shuffle(spark):
    """The whole query from the same matrix, row by row: local order, cut, exchange, order again."""
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    chunks = common.power_of_two(len(rows), sharding.ROWS_PER_CHUNK, sharding.MOST_CHUNKS)
    levels = chunks.bit_length() - 1
    counts = Counter(h32(r["doc_id"], "shards/at/") >> (32 - levels) for r in rows)
    table = spark.createDataFrame([(c, n) for c, n in counts.items()], "chunk long, n long")
    starts = {r.chunk: r.starts for r in sharding.communication_matrix(table, 8, levels, "shards").collect()}
    parts = {s: [] for s in range(8)}
    for r in rows:
        raw = (r["text"] or "").encode()
        r["size"], r["crc"], r["chunk"] = len(raw) + 1, zlib.crc32(raw), h32(r["doc_id"], "shards/at/") >> (32 - levels)
    for chunk in counts:
        mine = sorted((r for r in rows if r["chunk"] == chunk), key=lambda r: (h32(r["doc_id"], "shards/local/"), r["doc_id"], r["crc"], r["size"]))
        for s in range(8):
            parts[s] += mine[starts[chunk][s] : starts[chunk][s + 1]]
    want = set()
    for s, mine in parts.items():
        again = sorted(mine, key=lambda r: (h32(r["doc_id"], "shards/again/"), r["doc_id"], r["crc"], r["size"]))
        want |= {(r["doc_id"], r["size"], r["crc"], s, slot) for slot, r in enumerate(again)}
    got = {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in op4_sharding(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
    sizes = Counter(s for _, _, _, s, _ in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_many_chunks(spark, monkeypatch):
    """A deep halving, spread over tasks on its way, keeps row and column sums."""
    counts = spark.range(1 << 11).where("id % 3 > 0").select(F.col("id").alias("chunk"), (F.col("id") % 5).alias("n"))
    matrix = sharding.communication_matrix(counts, 8, 11, "deep").collect()
    want = {r.chunk: r.n for r in counts.collect()}
    assert len(matrix) == 1 << 11 and all(r.starts[-1] == want.get(r.chunk, 0) for r in matrix)
    columns = [sum(r.starts[s + 1] - r.starts[s] for r in matrix) for s in range(8)]
    assert sum(columns) == sum(want.values()) and max(columns) - min(columns) <= 1
