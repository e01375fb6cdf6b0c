"""Arrow string columns as NumPy bytes, without copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def strings(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The UTF-8 bytes of each text, and which texts are not null (null: no bytes)."""
    offsets, data = buffers(column)
    valid = np.asarray(column.is_valid())
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], valid


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and all bytes of a string column."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, bytes_ = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(1, dtype=kind), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None else np.zeros(0, dtype=np.uint8)
    return offsets, data
