"""Training-order materialisation: sequences at permuted global slots, in fixed-stride shards.

Each document's tokens, as bytes, end with an end mark and are cut into sequences of one length; the last
is padded. Sequences are numbered without gaps, and a keyed Feistel permutation of the numbers gives every
sequence its global slot: rounds on a grid of about equal sides, walking on along the cycle where the grid
is larger than the corpus. Slots are dealt to partitions by range, so each partition holds and writes
consecutive slots. Slot s stands in shard ``s // per_shard`` at byte ``s % per_shard * stride``: a reader
goes on from any slot by that sum alone, and reads forward.

The numbering needs no global sort: documents fall into narrow hash ranges, whose sums of sequences give
each range its first number, and are numbered inside their range.

Byte tokens: the UTF-8 bytes of the text are token ids of themselves (a vocabulary of bytes). UTF-8 never
has bytes over 0xF7, so two of these serve as end mark and padding. Ids of other vocabularies are packed
by :func:`packed_ids`, with their width and marks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import delete, hash32, materialise, new_path, power_of_two, ship_package, shuffles_removed

# Ids of the end mark and the padding among byte tokens.
END, PAD = 0xFF, 0xFE
#: Bytes of a sequence, rounds of the permutation.
STRIDE, ROUNDS = 512, 4
#: Sequences in a shard at least; doubled for large corpora until there are no more than MOST_SHARDS, or a shard has SHARD_BYTES.
PER_SHARD, MOST_SHARDS, SHARD_BYTES = 4096, 8192, 128 << 20
#: Documents in a numbering range aimed at, and the most ranges (their sums are broadcast; beyond 67 million documents
#: ranges grow). Steps of a walk that every row may take; each has about one chance in the square root of the number of
#: sequences to need another, and rows that need more walk on to the end.
PER_RANGE, MOST_RANGES, WALK = 64, 1 << 20, 8
#: Groups of shards that are written one after the other, at most.
MOST_GROUPS = 8


def sides(n: int) -> tuple[int, int]:
    """Sides of the least grid, nearly square, with n places."""
    a = max(1, int(n**0.5))
    return a, -(-n // a)


def shard_size(n: int, stride: int = STRIDE) -> int:
    """Sequences in a shard of a corpus of ``n``."""
    size = PER_SHARD
    while n > size * MOST_SHARDS and 2 * size * stride <= SHARD_BYTES:
        size *= 2
    return size


def permuted(index: Column, n: int, key: str) -> Column:
    """The slot of each index below n: a keyed permutation of 0 to n - 1."""
    a, b = sides(n)

    def mixed(half: Column, r: int) -> Column:
        text = F.concat(F.lit(f"{key}/{r}/"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")

    def once(x: Column) -> Column:
        state = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        for r in range(ROUNDS):  # each round adds a function of one side to the other
            left = r % 2 == 0
            step = (lambda s, r=r: F.struct(((s["l"] + mixed(s["r"], r)) % a).alias("l"), s["r"].alias("r"))) if left else (lambda s, r=r: F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], r)) % b).alias("r")))
            state = _let(state, step)
        return _let(state, lambda s: s["l"] + s["r"] * a)

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), start, lambda x, _: F.when(x < n, x).otherwise(once(x)))

    # a walk leaves the places beyond the corpus at last after as many steps as there are such places
    return _let(walk(once(index), WALK), lambda x: F.when(x < n, x).otherwise(walk(x, a * b - n)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def byte_tokens(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def packed_ids(encoded: DataFrame, *, ids_col: str = "ids", width: int = 2) -> DataFrame:
    """Rows with ``tokens``: their ids as little-endian unsigned integers of 2 or 4 bytes; null ids as none."""
    kind, at = {2: "<u2", 4: "<u4"}[width], encoded.columns.index(ids_col)
    ship_package(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            tokens = [np.asarray(x or [], dtype=kind).tobytes() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], names=[*batch.schema.names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, tokens binary")


def training_order(
    docs: DataFrame,
    *,
    tokens: Column | None = None,
    stride: int = STRIDE,
    per_shard: int | None = None,
    end: bytes = bytes([END]),
    pad: bytes = bytes([PAD]),
    key: str = "order",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every sequence of the corpus: ``slot, shard, byte_offset, doc_id, piece, tokens``, by range of slots.

    ``tokens`` are bytes (byte tokens of the text by default), ``stride`` is the length of a sequence in
    bytes, ``end`` and ``pad`` have the width of a token. Slots run from 0 without gaps; the concatenated
    pieces of a document, up to the end mark, are its tokens. A null or empty text has one sequence: the
    end mark and padding. Rows with one id are numbered by size and content, and are sequences each. An
    empty table gives an empty result. The order depends on the key and the ids, not on files or cluster.
    """
    found, n = _sequences(docs, tokens if tokens is not None else byte_tokens(F.col(text_col)), stride, end, pad, key, id_col)
    per_shard = per_shard or shard_size(n, stride)
    return _ranged(found, 0, -(-n // per_shard), per_shard, stride)


def _sequences(docs: DataFrame, tokens: Column, stride: int, end: bytes, pad: bytes, key: str, id_col: str) -> tuple[DataFrame, int]:
    """``slot, doc_id, piece, tokens`` of every sequence, in no order, and their number (1 if there is none)."""
    whole = F.concat(tokens, F.lit(bytearray(end)))
    rows = docs.select(F.col(id_col).alias("doc_id"), hash32(F.col(id_col), "slot/").alias("h"), whole.alias("bytes"))
    pieces = F.ceil(F.octet_length("bytes") / F.lit(stride)).cast("long")
    sizes = materialise(rows.select("h", pieces.alias("n")), "slot-sizes")
    totals = sizes.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    bits = power_of_two(totals["docs"], PER_RANGE, MOST_RANGES).bit_length() - 1
    part = F.shiftright("h", 32 - bits).cast("int")
    sums = sizes.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # at most MOST_RANGES rows
    inside = Window.partitionBy("part").orderBy("h", "doc_id", "n", F.crc32("bytes")).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("n", pieces).withColumn("part", part).withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(starts), "part")
    cut = placed.select("doc_id", "bytes", (F.col("start") + F.col("upto") - F.col("n")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("piece"))
    body = F.rpad(F.substring(F.col("bytes"), (F.col("piece") * stride + 1).cast("int"), F.lit(stride)), F.lit(stride), F.lit(bytearray(pad)))
    n = max(1, totals["n"])
    return cut.select(permuted(F.col("first") + F.col("piece"), n, key).alias("slot"), "doc_id", F.col("piece").cast("int").alias("piece"), body.alias("tokens")), n


def _ranged(found: DataFrame, first: int, shards: int, per_shard: int, stride: int) -> DataFrame:
    """Sequences of the ``shards`` shards from ``first`` on, sorted by slot; every shard lies in one partition."""
    wanted = -(-shards * per_shard * stride // SHARD_BYTES)
    tasks = min(max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted), shards)
    placed = found.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    ranged = placed.repartitionById(tasks, F.floor((F.col("shard").cast("long") - first) * tasks / shards).cast("int"))
    return ranged.sortWithinPartitions("shard", "slot").select("slot", "shard", ((F.col("slot") % per_shard) * stride).alias("byte_offset"), "doc_id", "piece", "tokens")


def store_shards(
    docs: DataFrame,
    path: str,
    *,
    tokens: Column | None = None,
    stride: int = STRIDE,
    per_shard: int | None = None,
    end: bytes = bytes([END]),
    pad: bytes = bytes([PAD]),
    key: str = "order",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the sequences of :func:`training_order` as raw shards to ``path``, and return what stands where.

    The result is ``slot, shard, byte_offset, doc_id, piece``: the sequence of a slot is the ``stride``
    bytes from ``byte_offset`` on of the file of ``path/shard=N``; ``path/layout`` says how long sequences are, how
    many a shard has and how many there are, which :func:`read_shards` goes by. ``path`` must be new. An empty table
    writes no shard. The sequences are first written by groups of shards; each group is then exchanged,
    written as shards and deleted, so that the disk never holds the corpus, its exchange and its shards at once.
    """
    spark = docs.sparkSession
    found, n = _sequences(docs, tokens if tokens is not None else byte_tokens(F.col(text_col)), stride, end, pad, key, id_col)
    per_shard = per_shard or shard_size(n, stride)
    shards = -(-n // per_shard)
    groups = max(1, min(MOST_GROUPS, shards // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-shards // groups)
    parked = new_path(spark, "slot-sequences")
    group = F.floor(F.col("slot") / (per_shard * each)).cast("int")
    with shuffles_removed(spark):
        found.withColumn("group", group).write.partitionBy("group").option("compression", "zstd").parquet(parked)
        parts = spark.read.schema(found.schema).option("recursiveFileLookup", True).parquet(parked)
        where = materialise(parts.select("slot", F.floor(F.col("slot") / per_shard).cast("int").alias("shard"), ((F.col("slot") % per_shard) * stride).alias("byte_offset"), "doc_id", "piece"), "slot-index")
        n = n if where.limit(1).count() else 0
        for first in range(0, shards if n else 0, each):
            one = f"{parked}/group={first // each}"
            write_shards(_ranged(spark.read.schema(found.schema).parquet(one), first, min(each, shards - first), per_shard, stride), path, lines=False)
            delete(spark, one)
    delete(spark, parked)
    layout = spark.range(1).select(F.lit(stride).alias("stride"), F.lit(per_shard).alias("per_shard"), F.lit(n).cast("long").alias("sequences"), F.lit(False).alias("lines"))
    layout.coalesce(1).write.json(f"{path}/layout")
    return where


def write_shards(ordered: DataFrame, path: str, *, lines: bool = True) -> None:
    """Write sequences (of :func:`training_order`) as files, ``path/shard=N``, slot after slot.

    Spark's text writer puts out the bytes and its committer publishes whole files, so a lost executor
    leaves no half shard. Each shard lies in one partition, hence in one file. With ``lines`` a line break
    closes each sequence, so that the stride of the file is one byte more than the sequence's and slot s
    stands at ``s % per_shard * (stride + 1)``, not at its ``byte_offset``. Without, nothing stands between
    sequences, each is found at its ``byte_offset``, and one line break closes the file; such shards are
    added to those that ``path`` has.
    """
    if lines:
        rows = ordered.select(F.col("shard"), F.col("tokens").cast("string").alias("value"))
        rows.write.mode("overwrite").option("maxRecordsPerFile", 0).option("compression", "none").partitionBy("shard").text(path)
        return
    ship_package(ordered.sparkSession)

    def joined(batches):  # the rows of a partition come by shard and slot
        shard, held = None, []
        for batch in batches:
            for s, t in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if s != shard and held:
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["shard", "value"])
                    held = []
                shard = s
                held.append(t)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["shard", "value"])

    rows = ordered.select("shard", "tokens").mapInArrow(joined, "shard int, value binary").select("shard", F.col("value").cast("string").alias("value"))
    rows.write.mode("append").option("maxRecordsPerFile", 0).option("compression", "none").partitionBy("shard").text(path)


def layout(spark: SparkSession, path: str) -> dict | None:
    """What :func:`store_shards` has written about the shards of ``path``; None for shards of :func:`write_shards` alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("stride int, per_shard long, sequences long, lines boolean").json(f"{path}/layout").head().asDict()


def read_shards(spark: SparkSession, path: str, *, stride: int = STRIDE, per_shard: int = PER_SHARD, start: int = 0, lines: bool = True) -> DataFrame:
    """``slot, tokens`` of written shards from slot ``start`` on; shards before it are not opened.

    Stored shards are read by their own layout, whatever the arguments say; ``stride``, ``per_shard`` and ``lines`` are
    those of shards that :func:`write_shards` has written alone.
    """
    if stored := layout(spark, path):
        stride, per_shard, lines = stored["stride"], stored["per_shard"], stored["lines"]
        if not stored["sequences"]:
            return spark.createDataFrame([], "slot long, tokens binary")
    files = spark.read.format("binaryFile").option("basePath", path).option("pathGlobFilter", "*.txt").load(f"{path}/shard=*")
    step, tail = (stride + 1, 0) if lines else (stride, 1)
    ship_package(spark)

    def cut(batches):  # whole files are cut here: in an expression every substring would copy its file
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), dtype=np.uint8)
                n = (len(raw) - tail) // step
                kept = np.ascontiguousarray(raw[: n * step].reshape(n, step)[:, :stride])
                offsets = np.arange(n + 1, dtype=np.int32) * np.int32(stride)
                tokens = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + np.arange(n, dtype=np.int64)), tokens], names=["slot", "tokens"])

    rows = files.where(F.col("shard") >= start // per_shard).select(F.col("shard").cast("long").alias("shard"), "content")
    return rows.mapInArrow(cut, "slot long, tokens binary").where(F.col("slot") >= start)
