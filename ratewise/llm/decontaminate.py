"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size: items with 2^c to 2^(c+1)-1 distinct word
shingles share a sketch length m_c, so each partition has its own threshold.
An item's sketch is its m_c smallest shingle hashes (bottom-m MinHash).  A
document that contains at least ``threshold`` of an item can miss at most d of
its n shingles, hence at most d of the sketch: m_c - d sketch hits are
required, and no containing document can be lost, however long it is.
Documents smaller than an item's least overlap are not compared with it.

Candidates are verified by exact containment: the documents found are read
again and their shingles, as 128-bit digests of the words themselves, are
joined with those of the candidate items.

What the tasks get is a Bloom filter of bounded size; hits are confirmed by
joins, so a larger benchmark only lets more rows through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, scratch
from .textbatch import flat, in_chunks, shingles, word_hashes, word_spans

_SPACES = b" \t\n\x0b\x0c\r"
#: Sketch hits asked for beyond the shingles that a containing document may miss.
EXTRA_HITS = 3


def text_shingles(text: bytes | None, k: int) -> set[bytes]:
    """128-bit digests of the distinct ``k``-word shingles (A-Z lower-cased)."""
    words = (text or b"").lower().translate(_TO_SPACE).split()
    return {xxhash.xxh3_128_digest(b" ".join(words[i:i + k])) for i in range(len(words) - k + 1)}


_TO_SPACE = bytes(0x20 if b in _SPACES else b for b in range(256))


def _batch_hashes(column):
    data, offsets = flat(column)
    starts, ends, counts = word_spans(data, offsets)
    return word_hashes(data, starts, ends), counts


def least_shared(n, percent: int):
    """Smallest number of ``n`` shingles that reaches ``percent``."""
    return -(-n * percent // 100)


def sketch_length(size_class: int, percent: int) -> int:
    """m_c: the most that an item of the partition may lack, and EXTRA_HITS."""
    top = 2 ** (size_class + 1) - 1
    return top - least_shared(top, percent) + EXTRA_HITS


def item_sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """``item_id, k, n, hash, need``: a row per sketch entry."""

    def run(batches):
        for batch in batches:
            rows = []
            words, counts = _batch_hashes(batch.column(1))
            ends = np.cumsum(counts)
            for item, e, c in zip(batch.column(0).to_pylist(), ends.tolist(), counts.tolist()):
                if not c:
                    continue
                kk = min(k, c)
                sh = shingles(words[e - c:e], np.array([c]), kk)[0]
                n = len(sh)
                m = min(n, sketch_length(n.bit_length() - 1, percent))
                need = max(1, m - (n - least_shared(n, percent)))
                rows += [(item, kk, n, h, need) for h in sh[:m].view(np.int64).tolist()]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["item_id", "k", "n", "hash", "need"])

    return items.mapInArrow(run, "item_id long, k int, n long, hash long, need long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs ``doc_id, item_id, item_shingles, shared, containment`` of the
    documents that hold at least ``percent`` of an item's distinct ``k``-word
    shingles.

    Words are runs of non-space with A-Z lower-cased.  An item of fewer than
    ``k`` words is one shingle of all its words; an item without words matches
    nothing, nor does a null or empty text.  Rows repeated with one ``doc_id``
    or ``item_id`` are joined as one set of shingles; rows without an id are
    left out.  Empty tables give an empty result; other columns are not read."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null")
    sketches = scratch(item_sketches(items, k, percent), "sketches")
    stats = sketches.groupBy("k").agg(F.count("*").alias("n"), F.min("n").alias("smallest")).collect()   # k rows at most
    sizes = {r["k"]: least_shared(r["smallest"], percent) for r in stats}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bloom_of(sketches, "hash", sum(r["n"] for r in stats)))   # 2^28 bits at most

    def probe(batches):
        for batch in batches:
            for part in in_chunks(batch, 1):
                words, counts = _batch_hashes(part.column(1))
                ids = part.column(0).to_numpy().astype(np.int64)
                for kk, least in sizes.items():
                    sets = [s if c >= kk else s[:0] for s, c in zip(shingles(words, counts, kk), counts)]
                    n = np.array([len(s) for s in sets], np.int64)
                    n[n < least] = 0
                    sets = [s[:m] for s, m in zip(sets, n)]
                    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    hit = np.flatnonzero(shared.value.has(every))
                    row = np.repeat(np.arange(len(n)), n)[hit]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), pa.array(np.full(len(hit), kk, np.int32)), pa.array(n[row]),
                         pa.array(every[hit].view(np.int64))], names=["doc_id", "k", "n_doc", "hash"])

    hits = docs.mapInArrow(probe, "doc_id long, k int, n_doc long, hash long")
    pairs = scratch(hits.join(sketches, ["k", "hash"])
                    .where(F.col("n_doc") >= F.ceil(F.col("n") * percent / 100))
                    .groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("hits"), F.min("need").alias("need"),
                                                      F.first("k").alias("k"))
                    .where(F.col("hits") >= F.col("need")).select("doc_id", "item_id", "k"), "candidates")
    found = spark.sparkContext.broadcast(bloom_of(pairs, "doc_id", pairs.count()))

    def digests(batches, only=None):
        for batch in batches:
            cols = [[], [], []]
            rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(),
                       batch.column(2).to_pylist())
            for i, t, kk in rows:
                for d in text_shingles(t, kk):
                    for c, v in zip(cols, (i, kk, d)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.binary())], names=["id", "k", "shingle"])

    def read_again(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            batch = batch.filter(pa.array(found.value.has(ids.view(np.uint64))))
            for kk in sizes:
                yield from digests([pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, kk, np.int32))],
                    names=["doc_id", "text", "k"])])

    schema = "id long, k int, shingle binary"
    in_items = (items.join(sketches.select("item_id", "k").distinct(), "item_id").select("item_id", "text", "k")
                .mapInArrow(digests, schema).distinct())
    n_items = in_items.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("item_shingles"))
    # only shingles that some item has are kept of a document before pairs are formed
    in_docs = (docs.mapInArrow(read_again, schema).withColumnRenamed("id", "doc_id")
               .join(in_items.withColumnRenamed("id", "item_id"), ["k", "shingle"])
               .groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("shared")))
    return (pairs.select("doc_id", "item_id").join(in_docs, ["doc_id", "item_id"]).join(n_items, "item_id")
            .where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
            .select("doc_id", "item_id", "item_shingles", "shared",
                    (F.col("shared") / F.col("item_shingles")).alias("containment")))
