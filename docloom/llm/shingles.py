"""Word-shingle hashes of many texts at once, with NumPy.

Words are runs without white space, with A-Z lower-cased. A word's hash is a polynomial over its
bytes, taken as a difference of running sums; a shingle's hash mixes the hashes of its words in order.
All arithmetic is modulo 2**64 and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docloom.llm.textbuffer import buffers

#: Bytes of text handled at once; a single longer text is cut at white space.
BLOCK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 2, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64) + _U(1))
_BYTE[65:91] = _BYTE[97:123]
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    return _TABLES


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` (bytes) starts, and its hash."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    power, inverse = _tables()
    done = 0
    while done < len(starts):
        at = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        stop = ends[upto - 1]
        if stop - at > BLOCK:  # one word longer than a block
            out[done] = _long_word(data[at:stop])
        else:
            sums = np.zeros(stop - at + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[at:stop]] * power[: stop - at], out=sums[1:])
            a = starts[done:upto] - at
            out[done:upto] = (sums[ends[done:upto] - at] - sums[a]) * inverse[a]
        done = upto
    return starts, mix(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _long_word(data: np.ndarray) -> np.uint64:
    power = _tables()[0]
    total, scale = _U(0), _U(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), BLOCK):
            piece = data[at : at + BLOCK]
            total = total + (_BYTE[piece] * power[: len(piece)]).sum() * scale
            scale = scale * power[BLOCK]
    return total


def shingle_hashes(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts that lie in ``data`` at ``offsets``, with a space after each.

    Returns the hashes and, for each text, where its own begin (one number more than texts). A text
    with fewer words than ``size`` has one shingle of all its words; one without words has none.
    """
    starts, words = word_hashes(data)
    n = len(offsets) - 1
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    factor = mix(np.arange(size, dtype=np.uint64) + _U(1000)) | _U(1)
    full = np.maximum(count - size + 1, 0)
    short = np.flatnonzero((count > 0) & (count < size))
    rows = np.where(count >= size, full, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(rows)])
    out = np.empty(begin[-1], dtype=np.uint64)
    if len(words) >= size:
        every = words[: len(words) - size + 1] * factor[0]
        for j in range(1, size):
            every += words[j : len(words) - size + 1 + j] * factor[j]
        long = np.flatnonzero(full)
        source = np.repeat(first[:-1][long] - begin[:-1][long], full[long])
        target = np.repeat(begin[:-1][long] - np.concatenate([[0], np.cumsum(full[long])])[:-1], full[long]) + np.arange(full.sum())
        out[target] = every[source + target]
    for k in short:
        out[begin[k]] = (words[first[k] : first[k + 1]] * factor[: count[k]]).sum() + _U(count[k])
    assert len(begin) == n + 1
    return mix(out), begin


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``a`` to ``b`` of a string column at a time: about BLOCK bytes, as (a, b, offsets, data with spaces between)."""
    offsets, data = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        yield a, b, *spaced(offsets[a : b + 1], data)
        a = b


def spaced(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts at ``offsets`` moved together with a space after each."""
    n = len(offsets) - 1
    where = offsets.astype(np.int64) - offsets[0] + np.arange(n + 1)
    out = np.full(where[-1], 32, dtype=np.uint8)
    keep = np.ones(where[-1], dtype=bool)
    keep[where[1:] - 1] = False
    out[keep] = data[offsets[0] : offsets[-1]]
    return where, out
