"""Words of a batch of texts as Arrow string columns, cut out of the flat byte
buffer without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textbatch import byte_class, flat

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _FOLD[data]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document numbers) of the maximal runs of true bytes; a
    document border ends a run."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(mask & (np.concatenate([[True], ~mask[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(mask & (np.concatenate([~mask[1:], [True]]) | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def strings(body: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A string column of consecutive pieces of ``body``."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))


def words_where(column: pa.Array, letters) -> tuple[pa.Array, np.ndarray]:
    """(words with A-Z lower-cased, their document numbers), in order.
    ``letters`` maps the flat bytes to a mask of the bytes of words."""
    data, offsets = flat(column)
    mask = letters(data)
    starts, ends, doc = runs(mask, offsets)
    return strings(ascii_lower(data[mask]), ends - starts), doc


def outside(ranges: list[tuple[int, int]]):
    """Letters are all bytes but those in the ranges."""
    table = ~byte_class(ranges)
    return lambda data: table[data]


def distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, the number among them of each word)."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all code points in a row, code points of each word)."""
    data, offsets = flat(words)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.diff(first[offsets])
