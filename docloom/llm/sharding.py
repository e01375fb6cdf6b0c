"""Uniform shuffle into shards of exact size.

The rows lie in chunks (narrow hash ranges of their id, so that a rerun finds the same chunks whatever
the files or the cluster look like). How many rows of each chunk go to each shard is a random matrix
with given row and column sums: the chunk sizes, and the shard sizes, which differ by one at most. In a
uniformly random arrangement that matrix follows the multivariate hypergeometric law, and it is drawn
from exactly that law, by halving: from the root, which holds all chunks, every node draws how much of
its left half goes to each shard, one hypergeometric number after another, and the rest falls to the
right half. Then each chunk permutes its rows and cuts them by its counts, the rows are exchanged, and
each shard permutes what it has received and numbers it.

All of it is SQL expressions. A hypergeometric number is found by inversion: the weights of all values
within ten standard deviations of the mode (and in the support) are built up from the mode by their
ratios, added up, and the value at a hashed uniform position is taken. What lies beyond has less
probability than the last bit of a double. A chunk is permuted by one task and a shard by many: shards
are cut into hash ranges too, whose sizes give each range its first slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import hash32, materialise, power_of_two, shuffles_removed

#: Rows in a chunk aimed at, and the most chunks: their counts, 8 MB at most, meet in one row, the root of the halving.
#: Beyond 67 million rows chunks grow, to some 50,000 rows at a hundred terabytes of documents.
ROWS_PER_CHUNK, MOST_CHUNKS = 64, 1 << 20
#: Levels of the halving after which its nodes are spread over tasks, and over how many.
SPREAD = {3: 16, 9: 512}


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of the keys: 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *(k.cast("string") for k in keys))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked rows among ``drawn`` of ``total`` rows, ``marked`` of which are marked, at probability u."""
    lo, hi = F.greatest(F.lit(0).cast("long"), drawn + marked - total), F.least(drawn, marked)
    n, m, d = (x.cast("double") for x in (total, marked, drawn))
    mode = F.greatest(lo, F.least(hi, F.floor((d + 1) * (m + 1) / (n + 2)).cast("long")))
    deviation = F.sqrt(F.greatest(F.lit(0.0), d * m * (n - m) * (n - d)) / F.greatest(n * n * (n - 1), F.lit(1.0)))
    reach = F.ceil(10 * deviation).cast("long") + 10
    state = F.struct(*(x.alias(k) for k, x in (("total", total), ("marked", marked), ("drawn", drawn), ("mode", mode), ("from", F.greatest(lo, mode - reach)), ("to", F.least(hi, mode + reach)), ("u", u))))

    def found(s: Column) -> Column:
        def up(k):  # weight of k over that of k - 1
            return (s["marked"] - k + 1).cast("double") * (s["drawn"] - k + 1) / (k.cast("double") * (s["total"] - s["marked"] - s["drawn"] + k))

        def range_(a, b):
            return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))

        one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        above = F.aggregate(range_(s["mode"] + 1, s["to"]), one, lambda a, k: F.struct((a["w"] * up(k)).alias("w"), (a["sum"] + a["w"] * up(k)).alias("sum")))["sum"]
        # from the mode down: first the total, then the weight of the lowest value
        downwards = F.reverse(range_(s["from"] + 1, s["mode"]))
        below = F.aggregate(downwards, one, lambda a, k: F.struct((a["w"] / up(k)).alias("w"), (a["sum"] + a["w"] / up(k)).alias("sum")))
        start = F.struct(below["w"].alias("w"), below["w"].alias("sum"), s["from"].alias("k"), (s["u"] * (1.0 + above + below["sum"])).alias("goal"))
        return F.aggregate(
            range_(s["from"] + 1, s["to"]),
            start,
            lambda a, k: F.when(a["sum"] > a["goal"], a).otherwise(F.struct((a["w"] * up(k)).alias("w"), (a["sum"] + a["w"] * up(k)).alias("sum"), k.alias("k"), a["goal"].alias("goal"))),
        )["k"]

    return F.element_at(F.transform(F.array(state), found), 1)


def _draw(seed: str, level: int):
    """One step over the shards: how much of the left half the next shard gets."""

    def step(a: Column, s: Column) -> Column:
        here = F.element_at(F.col("room"), s)
        u = uniform(F.lit(seed), F.lit(level), F.col("chunk"), s)
        got = F.when(a["want"] == 0, F.lit(0).cast("long")).otherwise(hypergeometric(a["have"], here, a["want"], u))
        after = lambda g: F.struct((a["want"] - g).alias("want"), (a["have"] - here).alias("have"), F.concat(a["out"], F.array(g)).alias("out"))
        return F.element_at(F.transform(F.array(got), after), 1)

    return step


def communication_matrix(counts: DataFrame, shards: int, levels: int, seed: str) -> DataFrame:
    """``chunk, starts`` from ``chunk, n``: at which of its rows a chunk's part for each shard begins.

    ``starts`` has ``shards + 1`` numbers, from 0 to the size of the chunk. Chunks are 0 to
    2 ** levels - 1; missing ones are empty.
    """
    every = counts.sparkSession.range(1 << levels).select(F.col("id").alias("chunk"), F.lit(0).cast("long").alias("n"))
    filled = counts.select(F.col("chunk").cast("long").alias("chunk"), "n").unionByName(every).groupBy("chunk").agg(F.sum("n").alias("n"))
    root = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "n"))), lambda x: x["n"]).alias("sizes"))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.floor(total / shards).cast("long")
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: whole + F.when(s < total % shards, 1).otherwise(0))
    nodes = root.select(F.lit(0).cast("long").alias("chunk"), "sizes", room.alias("room"))
    for level in range(levels):
        half = 1 << (levels - level - 1)
        left_size = F.aggregate(F.slice("sizes", 1, half), F.lit(0).cast("long"), lambda a, x: a + x)
        first = F.struct(left_size.alias("want"), F.aggregate("room", F.lit(0).cast("long"), lambda a, x: a + x).alias("have"), F.array().cast("array<long>").alias("out"))
        nodes = nodes.withColumn("start", first)

        nodes = nodes.withColumn("left", F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.col("start"), _draw(seed, level))["out"])
        halves = F.array(
            F.struct((F.col("chunk") * 2).alias("chunk"), F.slice("sizes", 1, half).alias("sizes"), F.col("left").alias("room")),
            F.struct((F.col("chunk") * 2 + 1).alias("chunk"), F.slice("sizes", half + 1, half).alias("sizes"), F.zip_with("room", "left", lambda a, b: a - b).alias("room")),
        )
        nodes = nodes.select(F.explode(halves).alias("x")).select("x.*")
        if level in SPREAD and levels > level + 3:
            nodes = nodes.repartition(SPREAD[level], "chunk")
    starts = F.aggregate("room", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return nodes.select("chunk", starts.alias("starts"))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, *, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``, of the rows that :func:`sharded` has received.

    Size is the UTF-8 bytes of the text plus 1 (1 for null, whose crc32 counts as that of the empty text).
    """
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    received = sharded(docs, shards, seed=seed, id_col=id_col, text_col=text_col)
    return received.select(F.col(f"row.`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot")


def sharded(docs: DataFrame, shards: int = 8, *, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns in their shards: ``row, shard, slot``; ``row`` has the columns of ``docs``.

    Shards 0 to ``shards - 1`` have equal numbers of rows, at most one apart; slots count from 0 in each
    shard without gaps; every arrangement is as likely as any other. Equal rows are dealt one by one: the
    method keeps no group together, so that a group with a third of all rows is no load. Rows with one id
    are ordered by text; a null id is an id like others. An empty table gives an empty result. Whole rows
    are permuted in their chunk, exchanged, written in the shared folder and permuted in their shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = hash32(F.col(id_col), f"{seed}/at/").alias("at")
    heads = materialise(docs.select(at), "shard-heads")
    chunks = power_of_two(heads.count(), ROWS_PER_CHUNK, MOST_CHUNKS)
    levels = chunks.bit_length() - 1
    chunk = F.shiftright("at", 32 - levels)
    matrix = materialise(communication_matrix(heads.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n")), shards, levels, seed), "shard-matrix")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        at,
        hash32(F.col(id_col), f"{seed}/local/").alias("local"),
        hash32(F.col(id_col), f"{seed}/again/").alias("again"),
    )
    permuted = F.row_number().over(Window.partitionBy("chunk").orderBy("local", "doc_id", "text_crc32", "size")) - 1
    sent = rows.withColumn("chunk", chunk).withColumn("place", permuted).join(matrix, "chunk")
    shard = F.size(F.filter("starts", lambda s: s <= F.col("place")))
    # an empty part has the start of the next one, so the count passes over it
    sent = sent.select("row", "doc_id", "size", "text_crc32", "again", (shard - 1).alias("shard"))
    ranges = max(1, chunks // shards)
    with shuffles_removed(docs.sparkSession):
        sent = materialise(sent.withColumn("range", F.shiftright("again", 32 - (ranges.bit_length() - 1))), "shard-sent")
    counts = sent.groupBy("shard", "range").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("first"))
    again = F.row_number().over(Window.partitionBy("shard", "range").orderBy("again", "doc_id", "text_crc32", "size")) - 1
    return sent.withColumn("again_at", again).join(firsts, ["shard", "range"]).select("row", "shard", (F.col("first") + F.col("again_at")).cast("long").alias("slot"))
