"""Vectorised words, shingles and hashes over the byte buffer of an Arrow
string column.

A batch is worked on as one flat byte array with document offsets; no Python
object is made per word.  Null texts have no bytes, so they count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; ``offsets`` starts at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: Words are runs of bytes other than [\x20\x09-\x0D].
SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])


def _table() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240607))
    t = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    t[65:91] = t[97:123]          # A-Z count as a-z
    return t


LOWER_TABLE = _table()


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 1)
        for name, base in (("p", _BASE), ("q", _INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """(starts, ends, per-document word counts) of the words of a batch."""
    m = ~space[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True           # a document border ends a word
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | cut[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: a polynomial over the
    bytes (as a difference of running sums, so one pass over the bytes), then
    mixed.  Works block by block, so a very long text needs no long tables."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            p, q = _pow(b - a + 1)
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum(LOWER_TABLE[data[a:b]] * p[:b - a], out=run[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (run[e] - run[s]) * q[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


_K = [U64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB,
                           0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's distinct ``k``-word shingle hashes, sorted.  With fewer
    than ``k`` words the whole sequence is one shingle; without words, none."""
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h += words[i:i + n] * _K[i]
        h = mix(h)
        out = []
        for e, c in zip(ends.tolist(), counts.tolist()):
            if c >= k:
                out.append(np.unique(h[e - c:e - k + 1]))
            elif c:
                x = words[e - c:e]
                out.append(mix((x * np.array(_K[:c])).sum(dtype=np.uint64, keepdims=True) + U64(c)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def batch_shingles(column: pa.Array, k: int) -> list[np.ndarray]:
    data, offsets = flat(column)
    starts, ends, counts = word_spans(data, offsets)
    return shingles(word_hashes(data, starts, ends), counts, k)


def in_chunks(batch: pa.RecordBatch, text_index: int, limit: int = 4 << 20):
    """Slices of a batch with at most ``limit`` text bytes, at least a row."""
    _, off = flat(batch.column(text_index))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
