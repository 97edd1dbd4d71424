"""Compressed bitmaps: sets of up to 65,536 numbers in the smallest of three forms.

A container is one byte for the form and its data: a sorted list of 16-bit
numbers, a plain bitmap of 8 KB, or runs (first number, further numbers).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of one container, as a power of two.
CHUNK_BITS = 16
LIST, PLAIN, RUNS = 0, 1, 2


def pack(values: np.ndarray) -> bytes:
    """Container of a sorted array of distinct numbers below 65,536."""
    v = values.astype(np.uint16)
    if len(v) == 1:
        return bytes([LIST]) + v.tobytes()
    ends = np.flatnonzero(np.diff(v.astype(np.int64)) != 1)
    first = v[np.r_[0, ends + 1]] if len(v) else v
    if 4 * len(first) < min(2 * len(v), 8192):
        last = v[np.r_[ends, len(v) - 1]]
        return bytes([RUNS]) + np.stack([first, last - first], 1).astype(np.uint16).tobytes()
    if 2 * len(v) <= 8192:
        return bytes([LIST]) + v.tobytes()
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[v] = 1
    return bytes([PLAIN]) + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    form, data = container[0], container[1:]
    if form == LIST:
        return np.frombuffer(data, np.uint16)
    if form == PLAIN:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.uint16)
    runs = np.frombuffer(data, np.uint16).reshape(-1, 2).astype(np.int64)
    size = runs[:, 1] + 1
    return (np.repeat(runs[:, 0] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())).astype(np.uint16)


@F.arrow_udf(T.BinaryType())
def packed_words(words: pa.Array) -> pa.Array:
    """Containers of lists of (number of the word in the chunk, 64 bits), each word once."""
    ends = words.offsets.to_numpy()
    at, bits = (words.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    out = []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        order = np.argsort(at[lo:hi])
        row, bit = np.nonzero(np.unpackbits(bits[lo:hi][order].astype("<i8").view(np.uint8).reshape(hi - lo, 8), axis=1, bitorder="little"))
        out.append(pack(at[lo:hi][order][row].astype(np.int64) * 64 + bit))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def members(container: pa.Array) -> pa.Array:
    """Numbers of each container, in order."""
    held = [unpack(c) for c in container.to_pylist()]
    ends = np.cumsum([0] + [len(v) for v in held]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*held, np.zeros(0, np.uint16)]).astype(np.int32)))
