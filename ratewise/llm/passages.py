"""Passages of many words that stand in several documents.

Every window of ``words`` words has an anchor: its word q-gram of smallest
hash, at the same place in each copy of the window.  Two occurrences of an
anchor lie in a common passage when the words that agree to its left and right
add up to ``words - q``; that is tested in steps of ``STEP`` words: a key for
each number of steps to the left holds those words, the q-gram and what must
then agree to the right.  So a passage of ``words`` words or more always shares
a key, and a key is shared by passages of over ``words - STEP`` words alone.
Anchors whose q-gram a twice-seen filter does not suspect never leave their
task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BITS, BLOCK_SCHEMA, Bloom, BloomPair, Scratch, filter_bits, merge_blocks, pair_to_batch
from .suffix_dedup import _sliding
from .textbatch import U64, flat, in_chunks, mix, word_hashes, word_spans

#: Words of an anchor, and of a step.
Q, STEP = 17, 8
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Runs:
    """Hashes of any run of the words of a batch, from running sums."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(words)
            power = np.full(n + 1, _BASE, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            self.inverse = np.full(n + 1, _INVERSE, np.uint64)
            self.inverse[0] = 1
            self.inverse = np.multiply.accumulate(self.inverse)
            self.sums = np.concatenate([[U64(0)], np.cumsum(words * power[:n])])

    def hash(self, start: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + U64(salt))


def anchors(words: np.ndarray, counts: np.ndarray, size: int):
    """(runs, anchor positions, their document numbers) of a batch."""
    runs = Runs(words)
    ends = np.cumsum(counts)
    if len(words) < size:
        return runs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = runs.hash(np.arange(len(words) - Q + 1), Q)
    order = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    low = _sliding(np.minimum, order, size - Q + 1, U64(0xFFFFFFFFFFFFFFFF))      # of the window starting here
    inside = np.zeros(len(low), bool)
    for e, c in zip(ends.tolist(), counts.tolist()):
        if c >= size:
            inside[e - c:e - size + 1] = True
    at = np.unique(low[inside] & U64(0xFFFFFFFF)).astype(np.int64)
    return runs, at, np.searchsorted(ends, at, "right")


def _batch(column: pa.Array, size: int):
    data, offsets = flat(column)
    starts, ends, counts = word_spans(data, offsets)
    return (*anchors(word_hashes(data, starts, ends), counts, size), counts)


def shared_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """``doc_id, n_passage_anchors`` of the documents that hold a passage of
    ``words`` words or more which another document holds too; passages of
    ``words - STEP`` words or fewer are never counted, those between may be.

    Words are runs without [\\x20\\x09-\\x0D], A-Z lower-cased.  Rows repeated
    with one ``doc_id`` are one document; rows without one are not read; null,
    empty and shorter texts hold none."""
    if words < Q + STEP:
        raise ValueError(f"passages have at least {Q + STEP} words")
    scratch = Scratch()
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a word is two bytes with its space at least, and every (words - Q + 2) / 2 words have an anchor
    expected = (src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6 * 2 // (words - Q + 2)
    log2 = filter_bits(int(expected))

    def first_pass(batches):
        pair = BloomPair(log2)
        for batch in batches:
            for part in in_chunks(batch, 1, 1 << 20):
                runs, at, _, _ = _batch(part.column(1), words)
                pair.add(runs.hash(at, Q))
        yield pair_to_batch(pair)

    merged = merge_blocks(src.mapInArrow(first_pass, BLOCK_SCHEMA), (1 << log2) // BLOCK_BITS)
    twice = src.sparkSession.sparkContext.broadcast(
        Bloom(log2, {r["block"]: bytes(r["twice"]) for r in merged.select("block", "twice").collect()}))     # 32 MB at most

    def keys(batches):
        for batch in batches:
            for part in in_chunks(batch, 1, 1 << 20):
                runs, at, doc, counts = _batch(part.column(1), words)
                hit = twice.value.has(runs.hash(at, Q))
                at, doc = at[hit], doc[hit]
                ends = np.cumsum(counts)
                left, right = at - (ends - counts)[doc], ends[doc] - at - Q
                ids = part.column(0).to_numpy().astype(np.int64)[doc]
                rest = words - Q - STEP + 1
                for i in range(rest // STEP + 1):
                    l, r = STEP * i, rest - STEP * i
                    fits = (left >= l) & (right >= r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[fits]), pa.array(at[fits] - (ends - counts)[doc[fits]]),
                         pa.array(runs.hash(at[fits] - l, l + Q + r, i + 1).view(np.int64))], names=["doc_id", "at", "key"])

    found = scratch(src.mapInArrow(keys, "doc_id long, at long, key long"), "passage-keys")
    several = scratch(found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key"), "passages")
    out = (found.join(several, "key", "left_semi").select("doc_id", "at").distinct()
           .groupBy("doc_id").agg(F.count("*").alias("n_passage_anchors")))
    return out
