"""Line dedup with two Bloom filters.

First pass: every task hashes its documents' line keys into a once-seen and a
twice-seen filter; filters are merged block by block, a bit that two tasks
set moving to the second one.  Second pass: only lines that the twice-seen
filter suspects leave their task, as (128-bit key hash, document); a grouped
count confirms them exactly and chooses the document whose lines stay.  The
filters never decide anything: a false positive is only a line shuffled for
nothing.  Their size follows the number of lines up to 2^28 bits (32 MB);
beyond that more lines are shuffled and the result stays the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BITS, BLOCK_SCHEMA, Bloom, BloomPair, Scratch, bloom_of, filter_bits, merge_blocks, pair_to_batch, scratch

STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None for keys under ``min_chars`` code points."""
    out = []
    for line in text.lower().split(b"\n"):      # bytes.lower() touches A-Z alone
        key = line.strip(STRIP)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(key if long else None)
    return out


def _texts(batch, i):
    return [t or b"" for t in batch.column(i).cast(pa.binary()).to_pylist()]


def lost_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``doc_id, dropped_keys``: the key hashes whose lines a document loses, as
    a scratch table of its own."""
    keep = Scratch()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n_lines = src.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    log2 = filter_bits(int(n_lines))

    def first_pass(batches):
        pair = BloomPair(log2)
        for batch in batches:
            keys: list[int] = []
            for t in _texts(batch, 1):
                keys += [xxhash.xxh3_64_intdigest(k) for k in {k for k in line_keys(t, min_chars) if k is not None}]
            pair.add(np.array(keys, np.uint64))
        yield pair_to_batch(pair)

    merged = merge_blocks(src.where("doc_id is not null").mapInArrow(first_pass, BLOCK_SCHEMA), (1 << log2) // BLOCK_BITS)
    twice = Bloom(log2, {r["block"]: bytes(r["twice"]) for r in merged.select("block", "twice").collect()})
    shared = docs.sparkSession.sparkContext.broadcast(twice)     # at most 2^28 bits

    def suspects(batches):
        for batch in batches:
            ids, keys = [], []
            for d, t in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                mine = list({k for k in line_keys(t, min_chars) if k is not None})
                if mine:
                    hit = shared.value.has(np.array([xxhash.xxh3_64_intdigest(k) for k in mine], np.uint64))
                    for i in np.flatnonzero(hit):
                        ids.append(d)
                        keys.append(xxhash.xxh3_128_digest(mine[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
                                             names=["doc_id", "key"])

    seen = keep(src.where("doc_id is not null").mapInArrow(suspects, "doc_id long, key binary").distinct(), "suspects")
    repeated = keep(seen.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_doc"))
                       .where(F.col("n") >= min_docs).drop("n"), "repeated")
    lost = scratch(seen.join(repeated, "key").where("doc_id <> keep_doc")
                   .groupBy("doc_id").agg(F.collect_list("key").alias("dropped_keys")), "lost-lines")
    keep.clear()
    return lost


def kept_lines(text: bytes, lost: list[bytes] | None, min_chars: int) -> tuple[list[bytes], int]:
    """(lines that stay, number of lines before)."""
    lines = text.split(b"\n")
    if not lost:
        return lines, len(lines)
    gone = set(lost)
    return [x for x, k in zip(lines, line_keys(text, min_chars))
            if k is None or xxhash.xxh3_128_digest(k) not in gone], len(lines)


def _applied(rows: DataFrame, key: str, lost: DataFrame, apply, schema) -> DataFrame:
    """``apply(batch, lists of lost keys)`` for all rows.  A filter of the ids
    that lose lines lets the texts of all others by the join; a false positive
    only goes through it for nothing."""
    lost = lost.toDF("lost_id", "dropped_keys")
    touched = rows.sparkSession.sparkContext.broadcast(bloom_of(lost, "lost_id", lost.count()))
    at, n = rows.columns.index(key), len(rows.columns)

    def loses(batch):
        ids = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        return touched.value.has(ids.view(np.uint64)) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)

    def none(batches):
        for batch in batches:
            rest = batch.filter(pa.array(~loses(batch)))
            yield apply(rest, [None] * rest.num_rows)

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(loses(batch)))

    def joined(batches):
        for batch in batches:
            yield apply(pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]), batch.column(n).to_pylist())

    # a merge join at every size, so that shuffle follows the input
    met = rows.mapInArrow(some, rows.schema).join(lost.hint("merge"), F.col(key) == F.col("lost_id"), "left").drop("lost_id")
    return rows.mapInArrow(none, schema).unionByName(met.mapInArrow(joined, schema))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_dropped, kept_sha256``.

    A key found in at least ``min_docs`` documents loses all its lines except
    in the largest ``doc_id`` that holds it.  Null or empty text is one empty
    line.  Rows repeated with one ``doc_id`` count as one document.  Rows
    without a ``doc_id`` are left whole and not counted.  An empty table gives
    an empty result; other columns are not read."""
    def apply(batch, lists):
        out = [[], [], []]
        for t, lost in zip(_texts(batch, 1), lists):
            kept, n = kept_lines(t, lost, min_chars)
            for col, v in zip(out, (n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())):
                col.append(v)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _applied(src, "doc_id", lost_lines(src, min_chars, min_docs), apply,
                    "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the lines dropped from ``text`` and, where there is such a
    column, ``n_chars`` counted anew; all other columns as they are.  A null
    text stays null."""
    names = docs.columns
    at = names.index("text")

    def apply(batch, lists):
        kept = [None if t is None else b"\n".join(kept_lines(t, lost, min_chars)[0]).decode("utf-8", "replace")
                for t, lost in zip(batch.column(at).cast(pa.binary()).to_pylist(), lists)]
        cols = list(batch.columns)
        cols[at] = pa.array(kept, pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            cols[i] = pa.array([None if t is None else len(t) for t in kept], cols[i].type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    # numbered columns: whatever the others are called, nothing clashes
    d = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return _applied(d, f"c{names.index('doc_id')}", lost_lines(docs, min_chars, min_docs), apply, docs.schema)
