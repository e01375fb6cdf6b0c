"""Words grouped with the more frequent words that differ from them by one letter.

Two words are near if one inserted, deleted or replaced code point makes one the other. A word of length L is near the
words of lengths L and L - 1 that, for some place i, begin with its first i letters and end with its last L - 1 - i.
In the order of the words the first ones are an interval; in the order of the words read backwards the last ones are
one too. So each place asks for the points of a rectangle (place in one order, place in the other), which a wavelet
tree reports.

The vocabulary is cut into blocks that fit a task. A block has the words of two lengths, L and L - 1, that share their
first p and last s letters, and looks for changes between them. One change leaves the first or the second half of what
lies between untouched, so every near pair lies in one of the two blocks of halves; a block that is too large is cut
again in the same way, its words going to both parts. Between halves of a single letter no more words fit than there
are letters, so blocks are bounded whatever the words, no pair is lost, and each is found in one block only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop, materialise, ship_package
from docloom.llm.wavelet import WaveletTree

#: Letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters between the shared ends of a block's words that a block may have, and those that a task handles at once.
LARGE, HELD = 1 << 16, 1 << 21
#: Rectangles asked for at once.
ASKED = 1 << 20
#: What words of a block share: the longer length, how many first and last letters, and these letters.
BLOCK = ("long", "first", "last", "head", "tail")


def runs(docs: DataFrame, *, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, run``: every maximal run of at least ``least`` letters of each whole text, with A-Z lower-cased.

    A null or empty text has none, and repeated rows have theirs each.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))


def counted(words: DataFrame, *, least: int = 1, seldom: int = 1) -> DataFrame:
    """``word, n``: the words of at least ``least`` code points that occur at least ``seldom`` times; null is no word."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seldom)


def _ends(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows of ``long, word, n`` under the block of their first and last letters."""
    size = F.char_length("word")
    return rows.select("long", first.cast("int").alias("first"), last.cast("int").alias("last"), F.substring(F.col("word"), F.lit(1), first.cast("int")).alias("head"), F.substring(F.col("word"), size - last.cast("int") + 1, last.cast("int")).alias("tail"), "word", "n")


def _halves(rows: DataFrame) -> DataFrame:
    """The two blocks of each row (``long, first, last, word, n``): changes after the first half, and within it."""
    gap = F.col("long") - F.col("first") - F.col("last")
    half = F.floor(gap / 2).cast("int")
    either = F.array(F.struct((F.col("first") + half).alias("first"), F.col("last").alias("last")), F.struct(F.col("first").alias("first"), (F.col("last") + gap - half).alias("last")))
    cut = rows.select("long", "word", "n", F.explode(either).alias("part"))
    return _ends(cut, F.col("part.first"), F.col("part.last"))


def _blocks(words: DataFrame) -> DataFrame:
    """Every word in the blocks of its length and of the next one, each cut until it is small enough."""
    size = F.char_length("word")
    both = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("long"))
    level = _halves(both.select("long", F.lit(0).alias("first"), F.lit(0).alias("last"), "word", "n"))
    gap, done, parked = F.col("long") - F.col("first") - F.col("last"), None, []
    while True:
        # a block needs a word of its longer length and another one; the counts are few rows beside the words
        sizes = level.groupBy(*BLOCK).agg(F.count("*").alias("rows"), F.max(F.char_length("word") == F.col("long")).alias("asks"))
        large = materialise(sizes.where((gap > 1) & (F.col("rows") * gap > LARGE) & F.col("asks")).select(*BLOCK), "large-blocks")
        parked.append(large)
        if not large.limit(1).count():
            small = level
        else:
            small = level.join(large, list(BLOCK), "left_anti")
        done = small if done is None else done.unionByName(small)
        if small is level:
            return done
        level = materialise(_halves(level.join(large, list(BLOCK), "left_semi").select("long", "first", "last", "word", "n")), "cut-blocks")


def _intervals(lines: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by block and letters, and for j letters and each place of the order, where rows with these j letters begin and end."""
    n, width = lines.shape
    keyed = np.concatenate([block.astype(">u4").view(np.uint8).reshape(n, 4), lines], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 4}").ravel(), kind="stable")
    lines, block = lines[order], block[order]
    differs = lines[1:] != lines[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    shared[block[1:] != block[:-1]] = -1
    shared = np.concatenate([[-1], shared, [-1]])
    place = np.arange(n)
    begin, end = np.empty((width + 1, n), dtype=np.int32), np.empty((width + 1, n), dtype=np.int32)
    for j in range(width + 1):
        opens = shared < j
        begin[j] = np.maximum.accumulate(np.where(opens[:-1], place, 0))
        end[j] = np.minimum.accumulate(np.where(opens[1:], place + 1, n)[::-1])[::-1]
    return order, begin, end


def _lines(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)


def links(middle: list[bytes], before: list[bytes], block: np.ndarray, gap: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs (a, b) of rows of the same block, each in both directions and once.

    ``middle`` are the letters between the block's shared ends, ``before`` the last shared letter in front of them;
    ``gap`` is how many letters the longer words have there, which are those that ``asks`` marks.
    """
    width, n = max(map(len, middle)), len(middle)
    letters = _lines(middle, width)
    order, begin, end = _intervals(letters, block)
    back, rbegin, rend = _intervals(_lines([t[::-1] for t in middle], width), block)
    place, rplace = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    place[order] = rplace[back] = np.arange(n)
    opens = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0]))  # rows come by block, in both orders too
    base = opens[np.cumsum(np.concatenate([[True], np.diff(block) != 0])) - 1]
    tree = WaveletTree((rplace - base)[order])
    earlier = np.concatenate([_lines(before, 1), letters[:, :-1]], axis=1)
    pairs = []
    for i in range(width):
        rows = np.flatnonzero(asks & (gap > i))
        a, e = begin[i][place[rows]], end[i][place[rows]]
        rest = gap[rows] - 1 - i
        c, d = rbegin[rest, rplace[rows]], rend[rest, rplace[rows]]
        more = (e - a > 1) & (d - c > 1)  # beside the word itself
        rows, a, e, c, d = (x[more] for x in (rows, a, e, c, d))
        for at in range(0, len(rows), ASKED):
            part = slice(at, at + ASKED)
            own = rows[part]
            which, number = tree.report(a[part].astype(np.int64), e[part].astype(np.int64), c[part] - base[own], d[part] - base[own])
            x, y = own[which], back[number + base[own[which]]]
            # of equal letters next to each other, the first stands for all in a deletion
            good = (x != y) & (asks[y] | (letters[x, i] != earlier[x, i]))
            x, y = x[good], y[good]
            shorter = ~asks[y]
            pairs.append((np.concatenate([x, y[shorter]]), np.concatenate([y, x[shorter]])))
    a, b = (np.concatenate(side) for side in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    return a, b


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _summed(table: pa.Table) -> pa.RecordBatch:
    """For each word of some whole blocks with near words: how many, and the one of largest n, first in order of ties."""
    words, n = table["word"].combine_chunks(), table["n"].to_numpy()
    block = table["block"].to_numpy()
    gap, asks = table["gap"].to_numpy().astype(np.int64), table["asks"].to_numpy()
    latin = lambda name: [t.encode("latin-1") for t in table[name].to_pylist()]
    a, b = links(latin("middle"), latin("before"), block, gap, asks)
    ranks = np.empty(len(words), dtype=np.int64)
    ranks[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((ranks[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0])) if len(a) else np.empty(0, np.int64)
    own, best = a[first], b[first]
    count = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(own)), pa.array(count), pa.array(n[best]), words.take(pa.array(best))], schema=_FOUND)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of a partition whose rows come block after block."""
    held, cells, key, number = [], 0, None, 0

    def numbered(batch: pa.RecordBatch) -> Iterator[tuple[bool, pa.Table]]:
        nonlocal key, number
        columns = [batch.column(c) for c in BLOCK]
        fresh = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = (this := tuple(c[0].as_py() for c in columns)) != key
        key = tuple(c[len(c) - 1].as_py() for c in columns) if batch.num_rows > 1 else this
        block = number + np.cumsum(fresh)
        number = int(block[-1])
        table = pa.table({**{c: batch.column(c) for c in ("word", "n", "middle", "before", "gap", "asks")}, "block": pa.array(block)})
        at = np.append(np.flatnonzero(fresh), batch.num_rows)
        if at[0]:
            yield False, table.slice(0, at[0])
        starts, sizes = at[:-1], np.diff(at)
        weight = np.maximum.accumulate(table["gap"].to_numpy().astype(np.int64))
        i = 0
        while i < len(starts):  # as many whole blocks as are handled at once
            j = i + 1
            while j < len(starts) and (starts[j] + sizes[j] - starts[i]) * weight[starts[j]] <= HELD:
                j += 1
            yield True, table.slice(starts[i], starts[j - 1] + sizes[j - 1] - starts[i])
            i = j

    for batch in batches:
        if not batch.num_rows:
            continue
        for opens, piece in numbered(batch):
            wide = pc.max(piece["gap"]).as_py()
            rows = sum(t.num_rows for t in held)
            if opens and held and (rows + piece.num_rows) * max(wide, cells) > HELD:
                yield _summed(pa.concat_tables(held))
                held, cells = [], 0
            held.append(piece)
            cells = max(cells, wide)
    if held:
        yield _summed(pa.concat_tables(held))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n``: how many words are near each word that has any, and the one of largest ``n``.

    ``words`` has distinct ``word`` (of letters up to U+00FF) and ``n``. Ties go to the first word in code-point order.
    """
    ship_package(words.sparkSession)
    size = F.char_length("word")
    rows = _blocks(words).select(
        *BLOCK, "word", "n",
        F.substring(F.col("word"), F.col("first") + 1, size - F.col("first") - F.col("last")).alias("middle"),
        F.substring(F.col("head"), F.col("first"), F.lit(1)).alias("before"),
        (F.col("long") - F.col("first") - F.col("last")).alias("gap"),
        (size == F.col("long")).alias("asks"),
    )
    dealt = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    parts = dealt.mapInArrow(_found, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def group_variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of ``words`` (distinct ``word`` and its ``n``, see :func:`counted`).

    A word's form is its near word of largest ``n`` (ties: the first in code-point order) if that is at least
    ``ratio`` (2 or more) times its own; else null. The root is the last word that forms lead to, the word itself
    without any. ``n_near`` is the number of near words. Other columns are not read; an empty table gives an empty
    result. Words of null, and letters beyond U+00FF, do not come out of :func:`runs`; they must not be here.
    """
    held = materialise(words.select("word", "n"), "spelling-words")
    near = near_words(held)
    rows = held.join(near, "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    out = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    out = materialise(out, "spelling-forms")
    drop(held)
    # each form is at least `ratio` times as frequent, which bounds the steps to a root; every round doubles them
    most = out.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)) + 1)
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
