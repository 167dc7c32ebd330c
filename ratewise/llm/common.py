"""Shared parts of the text operators: scratch tables, sharded Bloom filters
and label propagation over link tables.

Scratch tables are Parquet folders below the shared folder that
``spark.checkpoint.dir`` names; reading them back cuts the lineage, so a lost
executor re-reads files instead of recomputing the stages before.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a scratch file, where a bound on the rows is known.
FILE_ROWS = 100_000


def scratch(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.  With
    ``rows``, a bound on its rows, the last stage gets no more tasks than one
    for each FILE_ROWS, or one for each core: a small table is not spread over
    as many files as there are shuffle partitions.

    Counts per key that are joined back to the rows of the key go through
    here too: read from a table both sides of the join are plain exchanges,
    which AQE can split at a hot key; straight from the aggregate they would
    share its partitioning, and a hot key's rows would meet in one task."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Scratch tables of one call, deleted together once its result no longer
    reads any of them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        self.tables.append(scratch(df, name, rows))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


# --------------------------------------------------------------- Bloom filters
#: Bits of one block of a filter; blocks are the unit that tasks exchange.
BLOCK_BITS = 1 << 19
BLOCK_BYTES = BLOCK_BITS // 8
#: Largest filter that is broadcast: 2^28 bits = 32 MB, whatever the input size.
MAX_LOG2_BITS = 28
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def filter_bits(n_items: int, bits_per_item: int = 16) -> int:
    """log2 of the filter size for ``n_items``, between one block and the
    bound ``MAX_LOG2_BITS``.  Beyond the bound a filter only lets more false
    positives through; every user confirms exactly afterwards."""
    want = max(1, n_items * bits_per_item)
    return int(min(MAX_LOG2_BITS, max(BLOCK_BITS.bit_length() - 1, (want - 1).bit_length())))


def bloom_positions(keys: np.ndarray, log2_bits: int) -> list[np.ndarray]:
    """Three bit positions for each 64-bit key."""
    k = keys.astype(np.uint64, copy=False)
    out = []
    for m in _MIX:
        h = (k ^ (k >> np.uint64(31))) * m
        out.append(((h ^ (h >> np.uint64(29))) * _MIX[0] >> np.uint64(64 - log2_bits)).astype(np.int64))
    return out


class BloomPair:
    """Once-seen and twice-seen filters over one task's keys.  A key whose bits
    were all set before goes to the second filter as well."""

    def __init__(self, log2_bits: int):
        self.log2 = log2_bits
        self.once = np.zeros((1 << log2_bits) // 8, np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        uniq, count = np.unique(keys, return_counts=True)
        pos = bloom_positions(uniq, self.log2)
        seen = count > 1
        for p in pos:
            seen_bit = (self.once[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            before = seen_bit.astype(bool) if p is pos[0] else before & seen_bit.astype(bool)
        seen |= before
        for p in pos:
            np.bitwise_or.at(self.once, p >> 3, (1 << (p & 7)).astype(np.uint8))
            q = p[seen]
            np.bitwise_or.at(self.twice, q >> 3, (1 << (q & 7)).astype(np.uint8))

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for b in range(len(self.once) // BLOCK_BYTES):
            cut = slice(b * BLOCK_BYTES, (b + 1) * BLOCK_BYTES)
            if self.once[cut].any():
                yield b, zlib.compress(self.once[cut].tobytes(), 1), zlib.compress(self.twice[cut].tobytes(), 1)


BLOCK_SCHEMA = "block int, once binary, twice binary"


def pair_to_batch(pair: BloomPair) -> pa.RecordBatch:
    rows = list(pair.blocks())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
         pa.array([r[2] for r in rows], pa.binary())], names=["block", "once", "twice"])


def merge_blocks(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Merge the tasks' filters block by block.  A bit that two tasks have set
    in their once-seen filters is set in the merged twice-seen filter.  A task
    holds one pair of 64 KB buffers for each block dealt to it."""

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                once, twice = (np.frombuffer(zlib.decompress(v), np.uint8) for v in (x, y))
                if b in held:
                    o, t = held[b]
                    t |= twice | (o & once)
                    o |= once
                else:
                    held[b] = (once.copy(), twice.copy())
        for b, (o, t) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([zlib.compress(o.tobytes(), 1)], pa.binary()),
                 pa.array([zlib.compress(t.tobytes(), 1)], pa.binary())], names=["block", "once", "twice"])

    return blocks.repartition(min(n_blocks, 64), "block").mapInArrow(merge, BLOCK_SCHEMA)


class Bloom:
    """A read-only filter, broadcast to the tasks in compressed blocks."""

    def __init__(self, log2_bits: int, blocks: dict[int, bytes]):
        self.log2, self.packed, self._bits = log2_bits, blocks, None

    def __getstate__(self):
        return {"log2": self.log2, "packed": self.packed, "_bits": None}

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self._bits is None:
            bits = np.zeros((1 << self.log2) // 8, np.uint8)
            for b, x in self.packed.items():
                bits[b * BLOCK_BYTES:(b + 1) * BLOCK_BYTES] = np.frombuffer(zlib.decompress(x), np.uint8)
            self._bits = bits
        hit = np.ones(len(keys), bool)
        for p in bloom_positions(keys, self.log2):
            hit &= ((self._bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
        return hit


def bloom_of(df: DataFrame, column: str, n_items: int) -> Bloom:
    """The filter of a long column; its size is bounded by ``MAX_LOG2_BITS``."""
    log2 = filter_bits(n_items)

    def build(batches):
        pair = BloomPair(log2)
        for batch in batches:
            pair.add(np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        yield pair_to_batch(pair)

    merged = merge_blocks(df.select(F.col(column).cast("long")).mapInArrow(build, BLOCK_SCHEMA),
                          (1 << log2) // BLOCK_BITS)
    return Bloom(log2, {r["block"]: bytes(r["once"]) for r in merged.select("block", "once").collect()})


# ------------------------------------------------------------------ components
def components(edges: DataFrame, name: str, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, comp)`` with the
    smallest node reachable.  Alternating large-star and small-star rounds:
    each round links every node to the smallest neighbour known, so rows stay
    in the order of the links and the number of rounds in the logarithm of the
    longest path.  Each round is written to the scratch folder.  A hot centre
    only occurs as the common small end, which the grouped minimum folds
    before the shuffle."""
    e = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                name, rows)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to u's smallest; small star: the rest as well
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        new = scratch(large.join(lowest, "u").select(F.col("v").alias("x"), "m", "u")
                      .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("x").alias("u"), F.col("m").alias("v")))).alias("s"))
                      .select("s.*").where("u <> v").distinct(), name, None if rows is None else 2 * rows)
        # a star forest: every node has one parent, and no parent has one itself
        bad = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        chained = new.select(F.col("v").alias("u")).distinct().join(new.select("u"), "u", "left_semi")
        e = new
        if is_empty(bad.select("u").unionByName(chained)):
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def forest_roots(parents: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``node, comp`` for a forest ``parents(node, parent)`` in which every node
    has one smaller parent: each round jumps to the parent's parent, so rounds
    grow with the logarithm of the depth.  Roots are their own component."""
    now = scratch(parents.select("node", "parent", F.lit(True).alias("moved")), name, rows)
    while not is_empty(now.where("moved")):
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        now = scratch(now.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"),
                                                            F.col("above").isNotNull().alias("moved")), name, rows)
    return now.select("node", F.col("parent").alias("comp")).unionByName(
        now.select(F.col("parent").alias("node"), F.col("parent").alias("comp")).distinct())
