"""Near-duplicate groups with HyperMinHash.

One hash of each shingle is cut in two: its top bits choose one of 128 buckets, the rest competes for
the bucket's minimum. A register keeps a minimum as its number of leading zeros and ten bits of
mantissa, 16 bits in all; an empty bucket borrows from a full one, tried in an order of its own, so
that registers of short texts agree as often as those of long ones. Five registers make a band, 25
bands a sketch: two sets of similarity 0.8 share no band with a probability of 5e-5, two of 0.4 share
one with 0.23.

1. Texts with equal shingle sets (128-bit digests) are one class; its smallest document stands for it.
2. Classes that share a band key are a bucket. In each bucket every class is compared with the smallest
   one. Sizes and the collision-corrected estimate drop hopeless pairs (five and a half standard
   deviations under the threshold); the others are verified on their full shingle sets.
3. Verified links merge classes into components. A bucket that still holds several components is cut into
   blocks of bounded size, and every two blocks meet in one task. Sketches go there first: a pair of
   different components counts in the first bucket that it shares, and only members of pairs whose
   estimate is not hopeless come back. Those alone meet again with their full sets, and the task returns
   only links that join components. So no pair that the bands propose goes untested, yet neither all
   pairs nor a whole bucket ever lie in one place.

All tables between the steps are written in the shared folder: any executor can be lost, plans stay
short, and joins on keys that many rows share start from exchanges that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop, hash32, materialise, ship_package
from docloom.llm.shingles import blocks, mix, shingle_hashes

#: Registers, registers in a band, mantissa bits.
REGISTERS, BAND, MANTISSA = 128, 5, 10
BANDS = REGISTERS // BAND
_INDEX_BITS = REGISTERS.bit_length() - 1
_VALUE_BITS = 64 - _INDEX_BITS
#: Chance that registers of different minima agree: 0.18 of the mantissa's resolution.
COLLISION = 0.18 / (1 << MANTISSA)
#: Standard deviations that an estimate may lie under the threshold before a pair is dropped unverified.
MARGIN = 5.5
#: Bounds of a block of a bucket: members, and shingles on average.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 400_000

_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_VALUE_BITS)
_ORDER = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers (16 bits each) of a set given as its sorted distinct hashes, at least one."""
    first = np.searchsorted(hashes, _STARTS)
    least = hashes[np.minimum(first, len(hashes) - 1)]
    full = (least >> np.uint64(_VALUE_BITS)) == np.arange(REGISTERS, dtype=np.uint64)
    value = (least << np.uint64(_INDEX_BITS)) >> np.uint64(_INDEX_BITS)
    length = np.frexp(value.astype(np.float64))[1].astype(np.uint64)  # bits of the value
    mantissa = (value << (np.uint64(64) - length + np.uint64(1)).clip(0, 63)) >> np.uint64(64 - MANTISSA)
    out = ((np.uint64(_VALUE_BITS) - np.minimum(length, np.uint64(_VALUE_BITS))) << np.uint64(MANTISSA)) | mantissa
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = out[_ORDER[empty, full[_ORDER[empty]].argmax(axis=1)]]
    return out.astype(np.uint16)


def _sorted_sets(column: pa.Array, size: int):
    """Of each text in turn: the sorted distinct hashes of its shingles."""
    for _, _, offsets, data in blocks(column):
        hashes, begin = shingle_hashes(offsets, data, size)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            yield np.unique(hashes[a:b])


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """``id, n_shingles, s1, s2, sketch`` from ``id, text``: set size, set digest and registers."""

    def run(batches):
        for batch in batches:
            n, s1, s2, regs = [], [], [], []
            for hashes in _sorted_sets(batch.column("text"), size):
                n.append(len(hashes))
                s1.append(int(mix(hashes + np.uint64(1)).sum()) - (1 << 63) if len(hashes) else 0)
                s2.append(int(mix(hashes ^ np.uint64(0xABCDEF0123456789)).sum()) - (1 << 63) if len(hashes) else 0)
                regs.append(registers(hashes).tobytes() if len(hashes) else None)
            arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "s1", "s2", "sketch"])

    return rows.mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, sketch binary")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """``id, shingles`` from ``id, text``: the full set of shingle hashes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [s.view(np.int64) for s in _sorted_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles array<long>")


def _likely(x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of registers (rows) and set sizes leave a chance of the threshold."""
    estimate = ((x == y).mean(axis=1) - COLLISION) / (1 - COLLISION)
    smaller, larger = np.minimum(xn, yn), np.maximum(xn, yn)
    slack = MARGIN * np.sqrt(threshold * (1 - threshold) * (1 / REGISTERS + 1 / smaller))
    return (smaller * 100 >= larger * round(threshold * 100)) & (estimate >= threshold - slack)


def _registers_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _hopeful(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave a chance of the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y, xn, yn = _registers_of(batch.column("xs")), _registers_of(batch.column("ys")), batch.column("xn").to_numpy(), batch.column("yn").to_numpy()
                keep = pa.array(_likely(x, y, xn, yn, threshold))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("xn"), F.col("sketch").alias("xs")), "a")
    both = both.join(classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("yn"), F.col("sketch").alias("ys")), "b")
    percent = round(threshold * 100)
    fit = both.where((F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent))
    return fit.select("a", "b", "xn", "yn", "xs", "ys").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets have the similarity: 100 * intersection >= 100 * threshold * union."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(same * 100 >= (F.size("x") + F.size("y") - same) * round(threshold * 100)).select("a", "b")


def _blocked(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``band, nth, i, j, block, id, component, n_shingles, sketch``: each member once for every pair of blocks that its block is in."""
    full = members.join(classes, "id")
    size = full.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed = full.join(size, "band").withColumn("block", F.pmod(hash32(F.col("id"), "block/"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    return placed.withColumn("to", F.explode(pairs)).select("band", "nth", "to.i", "to.j", "block", "id", "component", "n_shingles", "sketch")


def _meeting(rows: DataFrame) -> DataFrame:
    """Rows of one pair of blocks next to each other, in one partition."""
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _groups(batches):
    """The tables of rows with equal ``band, i, j`` from batches in which such rows follow each other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        keys = [table[k].to_numpy() for k in ("band", "i", "j")]
        edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *edge[:-1]], edge, strict=False):
            yield table.slice(a, b - a)
        held = table.slice(edge[-1] if len(edge) else 0)
    if held is not None:
        yield held


def _partners(blocked: DataFrame, threshold: float) -> DataFrame:
    """``band, nth, i, j, block, id, component`` of members with a likely partner of another component across their two blocks."""
    columns = ["band", "nth", "i", "j", "block", "id", "component"]

    def run(batches):
        for table in _groups(batches):
            keep = _likely_members(table, threshold)
            if keep.any():
                yield from table.select(columns).filter(pa.array(keep)).to_batches()

    return _meeting(blocked).mapInArrow(run, "band long, nth int, i int, j int, block int, id long, component long")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks that meet in a table; members are placed by hash, so either can be empty."""
    blocks = table["block"].to_numpy()
    return np.flatnonzero(blocks == table["i"][0].as_py()), np.flatnonzero(blocks == table["j"][0].as_py())


def _first_shared(regs: np.ndarray, k: int, others: np.ndarray, nth: int) -> np.ndarray:
    """Whether band ``nth`` is the first that row k shares with each of the others."""
    mine, theirs = regs[k, : nth * BAND].reshape(nth, BAND), regs[others, : nth * BAND].reshape(len(others), nth, BAND)
    return ~(theirs == mine).all(axis=2).any(axis=1)


def _likely_members(table: pa.Table, threshold: float) -> np.ndarray:
    regs, sizes, component, nth = _registers_of(table["sketch"]), table["n_shingles"].to_numpy(), table["component"].to_numpy(), table["nth"][0].as_py()
    first, second = _sides(table)
    out = np.zeros(table.num_rows, dtype=bool)
    for k in first if len(second) else ():
        others = second[component[second] != component[k]]
        others = others[_likely(regs[others], regs[k], sizes[others], sizes[k], threshold)] if len(others) else others
        others = others[_first_shared(regs, k, others, nth)] if len(others) else others
        if len(others):
            out[k] = True
            out[others] = True
    return out


def _across(partners: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of components: pairs of component labels to be merged, each once."""
    percent = round(threshold * 100)

    def run(batches):
        for table in _groups(batches):
            links = _block_links(table, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*links, strict=True)], names=["a", "b"])

    full = partners.join(classes.select("id", "sketch"), "id").join(sets, "id")
    return _meeting(full).mapInArrow(run, "a long, b long").distinct()


def _block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Components linked across two blocks (or within one), each merger once."""
    table = table.combine_chunks()
    regs, nth = _registers_of(table["sketch"]), table["nth"][0].as_py()
    sets = [s.values.to_numpy() for s in table["shingles"]]
    component = table["component"].to_pylist()
    root = {c: c for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    first, second = _sides(table)
    if not len(first) or not len(second):
        return []
    size = np.array([len(sets[k]) for k in second])
    owner = np.repeat(np.arange(len(second)), size)
    every = np.concatenate([sets[k] for k in second])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    for k in first:
        mine = find(component[k])
        n = len(sets[k])
        hopeful = (np.array([find(component[m]) for m in second]) != mine) & (np.minimum(size, n) * 100 >= np.maximum(size, n) * percent)
        if hopeful.any():
            hopeful[hopeful] = _first_shared(regs, k, second[hopeful], nth)
        if not hopeful.any():
            continue
        lo, hi = np.searchsorted(every, sets[k], "left"), np.searchsorted(every, sets[k], "right")
        spans = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        same = np.bincount(owner[at], minlength=len(second))
        for m in np.flatnonzero(hopeful & (same * 100 >= (size + n - same) * percent)):
            a, b = find(component[k]), find(component[second[m]])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((min(a, b), max(a, b)))
    return out


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``links`` (a, b).

    Rounds: every node points at its smallest neighbour, if that is smaller; pointers are followed to
    their roots by doubling; links between different roots go on to the next round. Each round at least
    halves the nodes that still have links. A node with any number of links is a pre-aggregated minimum.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    nodes = None
    while edges.count():
        point = materialise(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "cc-point")
        while True:
            hop = point.join(point.select(F.col("a").alias("to"), F.col("to").alias("further")), "to")
            hopped = materialise(hop.select("a", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "cc-point")
            drop(point)
            point = hopped
            if not point.where("moved").limit(1).count():
                break
        point = point.select("a", "to")
        if nodes is None:
            nodes = point.select(F.col("a").alias("id"), F.col("to").alias("component"))
        else:
            moved = point.select(F.col("a").alias("component"), F.col("to").alias("root"))
            nodes = nodes.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        nodes = materialise(nodes, "cc-nodes")
        left = edges.join(point.withColumnRenamed("to", "x"), "a").select("b", "x").join(point.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        after = materialise(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
        drop(edges)
        edges = after
    drop(edges)
    return nodes if nodes is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    A document's set has its distinct shingles of ``shingle`` words (A-Z lower-cased, split at white
    space); a text with fewer words has one shingle, its whole sequence. Documents are linked when
    their sets' Jaccard similarity is at least ``threshold``, counted in whole percents;
    ``component_id`` is the smallest doc_id reachable over links, itself included, and the document of
    that id is kept. Texts that are null, empty or without words have no shingles and no links. Rows of
    one doc_id are one node, with one result each; a null doc_id counts as the smallest id. An empty
    table gives an empty result, and other columns are not looked at. Ids are integers.
    """
    ship_package(docs.sparkSession)
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    everyone = materialise(sketches(rows, shingle), "near-sketches")
    some = everyone.where("n_shingles > 0")
    classes = materialise(some.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "near-classes")
    reps = some.join(classes.select(F.col("rep").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi").dropDuplicates(["id", "s1", "s2"])
    reps = materialise(reps.select("id", "n_shingles", "sketch"), "near-reps")

    key = lambda k: F.xxhash64(k, F.substring(F.col("sketch"), k * (2 * BAND) + 1, F.lit(2 * BAND)))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("nth"), key(k).alias("band")))
    banded = reps.select("id", F.explode(keys).alias("k")).select("id", "k.nth", "k.band")
    shared = banded.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last")
    members = materialise(banded.join(shared.select("band", "centre"), "band"), "near-members")

    pairs = materialise(members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "near-pairs")
    hopeful = materialise(_hopeful(pairs, reps, threshold), "near-hopeful")
    drop(pairs)
    sets = materialise(_sets_of(rows, hopeful.select(F.col("a").alias("id")).union(hopeful.select(F.col("b").alias("id"))).distinct(), shingle), "near-sets")
    links = materialise(_verified(hopeful, sets, threshold), "near-links")
    drop(hopeful)
    labels = components(links)
    drop(links)

    labelled = materialise(members.select("band", "nth", "id").join(labels, "id", "left").select("band", "nth", "id", F.coalesce("component", "id").alias("component")), "near-labelled")
    drop(members)
    open_ = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    left = materialise(labelled.join(open_, "band"), "near-open")
    drop(labelled)
    partners = materialise(_partners(_blocked(left, reps), threshold), "near-partners")
    unread = materialise(partners.select("id").distinct().join(sets.select("id"), "id", "left_anti"), "near-unread")
    more = materialise(_sets_of(rows, unread, shingle), "near-sets") if unread.limit(1).count() else sets.limit(0)
    found = materialise(_across(partners, reps, sets.unionByName(more), threshold), "near-links")
    merged = components(found)
    every = labels.unionByName(left.select("id", "component").distinct().join(labels, "id", "left_anti"))
    moved = merged.select(F.col("id").alias("component"), F.col("component").alias("root"))
    labels = materialise(every.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "near-labels")
    for table in (left, partners, unread, sets, more, found):
        drop(table)

    named = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    placed = some.select("id", "n_shingles", "s1", "s2").join(materialise(named, "near-named"), ["s1", "s2"]).select("id", "n_shingles", "component")
    alone = everyone.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component"))
    kind = docs.schema[id_col].dataType
    return placed.unionByName(alone).select(
        F.nullif("id", F.lit(lowest)).cast(kind).alias("doc_id"),
        "n_shingles",
        F.nullif("component", F.lit(lowest)).cast(kind).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def _sets_of(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    return shingle_sets(rows.join(ids.hint("merge"), "id", "left_semi"), size)


def keep_representatives(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which one stays for each group, with all their columns.

    Rows of one id that stays, with one text, are copies too: the one with the smallest hash of all its columns
    stays (any one of several equal rows). Rows of one id with different texts all stay.
    """
    kept = near_duplicates(docs, shingle=shingle, threshold=threshold, id_col=id_col, text_col=text_col).where("kept")
    stays = materialise(kept.groupBy(F.col("doc_id").alias("__docloom_stays")).agg(F.count("*").alias("__docloom_n")), "near-stays")
    same = F.col(id_col).eqNullSafe(F.col("__docloom_stays"))
    alone = docs.join(stays.where("__docloom_n = 1").hint("merge"), same, "left_semi")
    repeated = stays.where("__docloom_n > 1")
    if not repeated.limit(1).count():
        return alone
    twins = docs.join(repeated.hint("merge"), same, "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = twins.groupBy(F.col(id_col).alias("__docloom_id"), F.sha2(F.col(text_col), 256).alias("__docloom_text")).agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))).alias("__docloom_row"))
    return alone.unionByName(one.select("__docloom_row.*"))
