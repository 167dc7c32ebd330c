"""Exact dedup by a tree-merge of sorted digest runs.

Every partition turns its texts into one sorted run of (digest, smallest id,
copies, bytes).  Partitions then exchange runs in binomial rounds: the node
number is written in base ``radix``, and in round r a node keeps the part of
its runs whose digest belongs to its own r-th digit and hands the others to
the peers that differ in that digit alone.  There is a node for each partition
and always a second round, so no exchange is a plain shuffle to the owners.
A receiver is a task of its own; it merges up to ``radix`` sorted runs (each in
blocks) and folds equal digests, keeping the smallest id, the sum of the copies,
and verifying that equal digests stand for equally long texts.  After the last round each node holds one digest range, complete and
free of repeats; no node ever holds more than its share, and a digest of
which a third of all rows are copies is folded at every level instead of
meeting in one place.

Digest: SHA-256 of the normalised text, so equal digests mean equal texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

RUN_SCHEMA = "node int, digests binary, ids binary, copies binary, lengths binary"
#: Stands for a null id: larger than every id.
NO_ID = np.iinfo(np.int64).max
#: Entries of one run block; a run is sent as a row for each block.
BLOCK = 1 << 16


def normalised(text: str = "text"):
    """Null as empty; every run of [\\x20\\x09-\\x0D] as one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fold(digest, ids, copies, lengths):
    """Merge sorted runs (timsort finds and merges them) and fold equal digests."""
    order = np.argsort(digest, kind="stable")
    digest, ids, copies, lengths = digest[order], ids[order], copies[order], lengths[order]
    first = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
    low, high = np.minimum.reduceat(lengths, first), np.maximum.reduceat(lengths, first)
    if (low != high).any():
        raise ValueError("equal digests of texts of unequal length")
    return digest[first], np.minimum.reduceat(ids, first), np.add.reduceat(copies, first), low


def _rows(node, run):
    digest, ids, copies, lengths = run
    for i in range(0, len(digest), BLOCK):
        s = slice(i, i + BLOCK)
        yield (node, digest[s].tobytes(), ids[s].tobytes(), copies[s].tobytes(), lengths[s].tobytes())


def _to_batch(rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                                      names=["node", "digests", "ids", "copies", "lengths"])


def _digit(digest: np.ndarray, r: int, radix: int, rounds: int) -> np.ndarray:
    """The r-th base-``radix`` digit of the node that owns a digest."""
    lead = digest.view(np.uint8).reshape(-1, 32)[:, :4].copy().view(">u4").ravel().astype(np.int64)
    return (lead % radix ** rounds) // radix ** r % radix


def _dealt(node: int, run, r: int, radix: int, rounds: int):
    """The run cut by its r-th digit, for the node itself and its peers."""
    digit = _digit(run[0], r, radix, rounds)
    rest = node - (node // radix ** r % radix) * radix ** r
    for d in np.unique(digit):
        yield from _rows(int(rest + d * radix ** r), tuple(x[digit == d] for x in run))


def merge_runs(digests: DataFrame, nodes: int, radix: int = 4) -> DataFrame:
    """``digests(doc_id, digest, n_bytes)`` → one row per distinct digest:
    ``(digest, keep_id, group_size)``."""
    rounds = 2
    while radix ** rounds < nodes:
        rounds += 1
    total = radix ** rounds

    def leaf(batches):
        from pyspark import TaskContext
        node = TaskContext.get().partitionId() % total
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), "S32")
            run = (digest, ids, np.ones(len(ids), np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            held = run if held is None else tuple(np.concatenate(x) for x in zip(held, run))
            held = fold(*held)
            if len(held[0]) >= 1 << 20:     # a longer run goes out in parts, each sorted
                yield _to_batch(list(_dealt(node, held, 0, radix, rounds)))
                held = None
        if held is not None:
            yield _to_batch(list(_dealt(node, held, 0, radix, rounds)))

    def merging(r: int):
        def merge(batches):
            held: dict[int, list] = {}
            for batch in batches:
                for node, *cols in zip(*(c.to_pylist() for c in batch.columns)):
                    held.setdefault(node, []).append(tuple(
                        np.frombuffer(x, t) for x, t in zip(cols, ("S32", np.int64, np.int64, np.int64))))
            for node in sorted(held):
                run = fold(*(np.concatenate(x) for x in zip(*held.pop(node))))
                rows = list(_rows(node, run) if r == rounds else _dealt(node, run, r, radix, rounds))
                for i in range(0, len(rows), 64):
                    yield _to_batch(rows[i:i + 64])
        return merge

    def unpack(batches):
        for batch in batches:
            for d, i, c in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                ids, copies = np.frombuffer(i, np.int64), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(ids), [None, pa.py_buffer(d)]).cast(pa.binary()),
                     pa.array(ids, mask=ids == NO_ID), pa.array(copies)], names=["digest", "keep_id", "group_size"])

    runs = digests.select("doc_id", "digest", "n_bytes").mapInArrow(leaf, RUN_SCHEMA)
    for r in range(1, rounds + 1):
        runs = runs.repartitionById(total, F.col("node")).mapInArrow(merging(r), RUN_SCHEMA)
    return runs.mapInArrow(unpack, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, rows_per_node: int = 4_000_000, radix: int = 4) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  Null
    text counts as empty; an empty text is a text like any other.  Of equal
    texts the smallest ``doc_id`` stays; a null ``doc_id`` counts as larger
    than every id.  Rows repeated with the same id count as copies of
    themselves and are all marked kept if theirs is the smallest id.  An empty
    table gives an empty result.  There are as many merging nodes as the
    table has partitions, and more where one would hold over ``rows_per_node``
    entries (about 56 bytes each)."""
    text = normalised()
    digests = scratch(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"),
                                  F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    nodes = max(digests.rdd.getNumPartitions(), -(-digests.count() // rows_per_node))
    groups = merge_runs(digests, nodes, radix).where("group_size > 1")
    return (digests.join(groups, "digest", "left")
            .select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
