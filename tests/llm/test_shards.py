import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, shards
from tests.llm.conftest import make_docs, words


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 100, 1009, 4099])
def test_permutation(spark, n):
    got = [r.s for r in spark.range(n).select(shards.permuted(F.col("id"), n, "k").alias("s")).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        other = [r.s for r in spark.range(n).select(shards.permuted(F.col("id"), n, "other").alias("s")).collect()]
        assert got != other and sum(a == b for a, b in zip(got, other)) < 20 and sum(i == s for i, s in enumerate(got)) < 20


def texts_of(rows, stride, end=b"\xff"):
    """Documents put together again from their pieces."""
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        assert len(r.tokens) == stride
        out.setdefault(r.doc_id, []).append(bytes(r.tokens))
    return {d: b"".join(p).split(end)[0] for d, p in out.items()}


def test_round_trip_and_layout(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, "é😀" * (i % 3) + words(rng, rng.choice([0, 1, 5, 60, 400])), "en", "a") for i in range(300)]
    docs = make_docs(spark, rows).repartition(5)
    out = shards.training_order(docs, stride=64, per_shard=100)
    got = out.collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 64 for r in got)
    assert texts_of(got, 64) == {d: t.encode() for d, t, *_ in rows}
    again = shards.training_order(docs.repartition(2), stride=64, per_shard=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))

    shards.write_shards(out, f"{tmp_path}/shards")
    files = sorted((tmp_path / "shards").glob("shard=*/*.txt"))
    assert len(files) == -(-len(got) // 100) and {f.stat().st_size for f in files[:1]} == {100 * 65}
    by_slot = {r.slot: bytes(r.tokens) for r in got}
    assert {r.slot: bytes(r.tokens) for r in shards.read_shards(spark, f"{tmp_path}/shards", stride=64, per_shard=100).collect()} == by_slot
    rest = shards.read_shards(spark, f"{tmp_path}/shards", stride=64, per_shard=100, start=250).collect()
    assert {r.slot for r in rest} == set(range(250, len(got)))
    raw = next(f for f in files if f.parent.name == "shard=2").read_bytes()
    assert raw[7 * 65 : 7 * 65 + 64] == by_slot[207]


@pytest.mark.parametrize("groups", [1, 3])
def test_offsets_find_their_sequences(spark, tmp_path, monkeypatch, groups, empty):
    """The bytes at byte_offset of a stored shard are the sequence's tokens."""
    monkeypatch.setattr(shards, "MOST_GROUPS", groups)
    rng = random.Random(15)
    docs = make_docs(spark, [(i, "é😀\n" * (i % 3) + words(rng, rng.choice([0, 1, 5, 60, 400])), "en", "a") for i in range(300)]).repartition(5)
    path = f"{tmp_path}/raw"
    where = shards.store_shards(docs, path, stride=64, per_shard=100)
    tokens = {(r.doc_id, r.piece): (r.slot, r.shard, r.byte_offset, bytes(r.tokens)) for r in shards.training_order(docs, stride=64, per_shard=100).collect()}
    files = list((tmp_path / "raw").glob("shard=*/*.txt"))
    raw = {int(f.parent.name[6:]): f.read_bytes() for f in files}
    assert len(files) == len(raw) == -(-len(tokens) // 100)
    assert {(r.doc_id, r.piece): (r.slot, r.shard, r.byte_offset, raw[r.shard][r.byte_offset : r.byte_offset + 64]) for r in where.collect()} == tokens
    assert sum(map(len, raw.values())) == 64 * len(tokens) + len(raw)
    read = {r.slot: bytes(r.tokens) for r in shards.read_shards(spark, path, start=150).collect()}
    assert read == {slot: t for slot, _, _, t in tokens.values() if slot >= 150}
    assert shards.layout(spark, path) == {"stride": 64, "per_shard": 100, "sequences": len(tokens), "lines": False}
    assert shards.store_shards(empty, f"{tmp_path}/none").count() == 0
    assert shards.read_shards(spark, f"{tmp_path}/none").count() == 0


def test_query_with_larger_shards(spark, monkeypatch):
    """More sequences than MOST_SHARDS shards of the usual size hold: shards double, and every digest stays."""
    from docloom.llm import queries

    ask = lambda: {(r.doc_id, r.piece): (r.slot, r.tokens_sha256) for r in queries.op8_training_shards(spark, "/root/testdata/sf0.001").collect()}
    usual = ask()
    monkeypatch.setattr(shards, "PER_SHARD", 256)
    monkeypatch.setattr(shards, "MOST_SHARDS", 2)
    assert shards.shard_size(len(usual)) > 256
    rows = queries.op8_training_shards(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(usual) and {(r.doc_id, r.piece): (r.slot, r.tokens_sha256) for r in rows} == usual


def test_query_reads_its_shards(spark, monkeypatch):
    """The registered query writes shards, and its digests are those of the bytes at its offsets."""
    from hashlib import sha256
    from pathlib import Path

    from docloom.llm import queries

    paths = []
    new = queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    rows = queries.op8_training_shards(spark, "/root/testdata/sf0.001").collect()
    raw = {int(f.parent.name[6:]): f.read_bytes() for f in Path(paths[0].removeprefix("file:")).glob("shard=*/*.txt")}
    assert rows and all(sha256(raw[r.shard][r.byte_offset : r.byte_offset + 512]).hexdigest() == r.tokens_sha256 for r in rows)


def test_token_ids(spark):
    rng = random.Random(14)
    docs = make_docs(spark, [(i, words(rng, 30), "en", "a") for i in range(40)])
    encoded = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    end, pad = (50256).to_bytes(2, "little"), (50257).to_bytes(2, "little")
    out = shards.training_order(shards.packed_ids(encoded), tokens=F.col("tokens"), stride=32, end=end, pad=pad).collect()
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    seen = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        seen.setdefault(r.doc_id, []).extend(int.from_bytes(r.tokens[i : i + 2], "little") for i in range(0, 32, 2))
    assert {d: v[: v.index(50256)] for d, v in seen.items()} == ids and all(set(v[v.index(50256) + 1 :]) <= {50257} for v in seen.values())


def test_odd_rows(odd, odd_rows, empty):
    got = shards.training_order(odd, stride=128).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    have = {}
    for d, t, *_ in odd_rows:
        have.setdefault(d, []).append((t or "").encode())
    assert sum(1 for r in got if r.piece == 0) == len(odd_rows)
    for d, t in texts_of([r for r in got if r.doc_id != 2], 128).items():
        assert [t] == have[d]
    assert shards.training_order(empty).count() == 0


def test_long_walks_end(spark, monkeypatch):
    """Without steps that every row takes, all rows still reach a slot of their own."""
    monkeypatch.setattr(shards, "WALK", 1)
    for n in (2, 7, 5 * 6 - 1, 10 * 10 + 1):
        slots = [r.s for r in spark.range(n).select(shards.permuted(F.col("id"), n, "k").alias("s")).collect()]
        assert sorted(slots) == list(range(n))


def test_shard_sizes_follow_the_corpus():
    assert shards.shard_size(1) == shards.shard_size(10**6) == shards.PER_SHARD
    assert shards.shard_size(2 * 10**11) * shards.STRIDE == shards.SHARD_BYTES


def test_empty_tables(spark, empty, tmp_path):
    none = spark.createDataFrame([], "doc_id long, ids array<int>")
    assert shards.packed_ids(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.tokens) for r in shards.packed_ids(nulls).collect()} == {b""}
    shards.write_shards(shards.training_order(empty), f"{tmp_path}/none")
    schema = "slot long, shard int, byte_offset long, doc_id long, piece int, tokens binary"
    assert shards.training_order(empty).count() == 0 and len(schema.split(",")) == len(shards.training_order(empty).columns)
