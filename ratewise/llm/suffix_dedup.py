"""Substring dedup by bucket-pointer refinement.

Suffixes are put in buckets by their first q bytes (q = 50).  Buckets are
refined by the text bytes at offsets further out, which stand in for the bucket
identifiers of those offsets: only anchors have identifiers, so the offsets
between them have none to look up.  Each node carries these bytes (up to 350),
and each refined identifier is what the next, finer refinement of the same
anchor starts from; nothing is sorted, nor looked up at other anchors.

Positions.  Not every position is carried.  An anchor is a position whose
q-gram hash is the smallest of some window of ``length`` bytes, so every such
string holds an anchor, at the same place in each of its copies.  For an
anchor a, the strings that hold its q-gram start at a - j, 0 <= j <=
length - q.  A node (lo, hi) stands for j in lo..hi; two identifiers belong
to it:
  core  the bytes that all of its strings share,  a - lo .. a + length - hi
  full  the bytes that they cover together,       a - hi .. a + length - lo
The root's core is the q-gram, the initial bucket.  If a node's core occurs
once, none of its strings repeats and it is dropped.  If its full bytes occur
again, all of them repeat and their bytes are covered.  Otherwise the bucket
is refined, with one node for all that have the same full bytes: the children's identifiers are made of the node's core identifier
and the bytes at the offsets next to it, down to single strings.

Identifiers are 128-bit digests, so all rounds are grouped counts and joins
on them; a bucket of which a third of all rows are members is folded before
the shuffle and split by the joins.  Texts are shuffled for documents with an
open anchor or a removed byte alone, which Bloom filters of bounded size tell
(a false positive is only shuffled for nothing).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, discard, scratch
from .textbatch import LOWER_TABLE, U64, _pow, flat

Q = 50
#: Node widths of the refinement rounds after the root.
STEPS = (50, 7, 1)
#: Stretches with a period of up to this are settled inside their document.
PERIOD = 32
#: Bytes worked on at a time: the arrays over them stay in the cache.
_CHUNK = 1 << 16
#: The byte table for substrings is case-sensitive.
_TABLE = LOWER_TABLE * U64(0x2545F4914F6CDD1D) + np.arange(256, dtype=np.uint64) * U64(0x9E3779B97F4A7C16)
_TABLE = _TABLE | U64(1)


def _sliding(op, x: np.ndarray, w: int, pad) -> np.ndarray:
    """``op`` over every window of ``w`` entries (van Herk's two running passes)."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, pad, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n - w + 1], ahead[w - 1:n])


def short_period_runs(data: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches with a period of up to ``PERIOD``
    bytes that are at least a period longer than ``length``."""
    out = []
    half = length // 2
    for t in range(1, min(PERIOD, len(data) - length) + 1):
        same = data[:-t] == data[t:]
        m = len(same) // half * half
        if not same[:m].reshape(-1, half).all(axis=1).any():
            continue            # ``length`` equal bytes hold an aligned half
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        long = np.flatnonzero(edge[1::2] - edge[::2] >= length)
        out += [(u, v + t, t) for u, v in zip(edge[2 * long].tolist(), edge[2 * long + 1].tolist())]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(anchor positions, covered ranges) in the flat bytes of some documents.

    Each window's anchor is its leftmost smallest q-gram hash.  In a stretch
    of period t all strings recur after t bytes, so the stretch is covered and
    its first t windows stand for the others."""
    n, w = len(data), length - Q + 1
    if n < length:
        return np.zeros(0, np.int64), []
    with np.errstate(over="ignore"):
        p, inv = _pow(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * p[:n], out=run[1:])
        x = (run[Q:] - run[:-Q]) * inv[:n - Q + 1]
        x ^= x >> U64(31)
        x *= U64(0xD6E8FEB86659FD93)
    x &= U64(0xFFFFFFFF00000000)
    x |= np.arange(len(x), dtype=np.uint64)
    low = _sliding(np.minimum, x, w, U64(0xFFFFFFFFFFFFFFFF))      # of the window starting here
    inside = np.zeros(len(low), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            inside[a:b - length + 1] = True
    covered = []
    for u, v, t in short_period_runs(data, length):
        cuts = np.unique(np.concatenate([[u, v], offsets[(offsets > u) & (offsets < v)]])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):        # a stretch may cross documents
            if b - a >= length + t:
                covered.append((a, b))
                inside[a + t:b - length + 1] = False
    return np.unique(low[inside] & U64(0xFFFFFFFF)).astype(np.int64), covered


def batch_anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """((document index, position) of a batch's anchors, (document index,
    start, end) of its covered stretches); texts are worked on in pieces, a
    long one in overlapping pieces."""
    places, spans = [np.zeros(0, np.int64)], []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= _CHUNK:
            pieces = [(a, b, offsets[i:j + 1] - a)]
        else:                       # one long document
            pieces = [(s, min(b, s + _CHUNK), np.array([0, min(b, s + _CHUNK) - s]))
                      for s in range(a, max(a + 1, b - length + 1), _CHUNK - 2 * length)]
        for s, e, inner in pieces:
            at, covered = anchors(data[s:e], inner, length)
            places.append(at + s)
            spans += [(u + s, v + s) for u, v in covered]
        i = j
    at = np.unique(np.concatenate(places))
    d = np.searchsorted(offsets, at, "right") - 1
    spans = np.array(spans, np.int64).reshape(-1, 2)
    owner = np.searchsorted(offsets, spans[:, 0], "right") - 1
    return (d, at - offsets[d]), (owner, spans[:, 0] - offsets[owner], spans[:, 1] - offsets[owner])


def _digest(*parts: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(parts))


def _span(a: int, n: int, length: int) -> tuple[int, int]:
    """The j of the strings that hold an anchor and lie inside the document."""
    return max(0, length - (n - a)), min(length - Q, a)


NODE_SCHEMA = ("core binary, full binary, doc_id long, part long, pos long, lo int, hi int, low int, high int, left binary, right binary")
_TYPES = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
_NAMES = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def children(core: bytes, lo: int, hi: int, low: int, high: int, left: bytes, right: bytes, step: int):
    """The nodes of width ``step`` below (lo, hi), whose valid j are low..high.
    ``left`` are the bytes a - high .. a - lo, ``right`` those after the core
    up to a + length - low."""
    for c in range(lo, hi + 1, step):
        d = min(c + step - 1, hi)
        if d < low or c > high:
            continue
        c2, d2 = max(c, low), min(d, high)
        l_core, r_core = left[len(left) - (c - lo):], right[:hi - d]
        l_full, r_full = left[len(left) - (d2 - lo):] if d2 > lo else b"", right[:hi - c2]
        key = _digest(core, b"c%d,%d" % (c, d), l_core if c > lo else b"", b"|", r_core)
        yield (key, _digest(core, b"f%d,%d" % (c2, d2), l_full, b"|", r_full), c, d, c2, d2,
               l_full[:len(l_full) - (c - lo)] if c > lo else l_full, r_full[hi - d:])


def _node_batch(rows):
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of an (n, 2) array of [start, end) ranges."""
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    first = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(s) - 1]])
    return np.stack([s[first, 0], reach[last]], axis=1)


ROUND_SCHEMA = "doc_id long, part long, start long, end long, core binary"


def _settle(batches):
    """Per document: its covered ranges merged, and the identifiers of nodes
    that could still cover more than that."""
    for batch in batches:
        out = [[], [], [], [], []]
        for i, part, rows in zip(*(batch.column(c).to_pylist() for c in range(3))):
            known = np.array([(r["start"], r["end"]) for r in rows if r["core"] is None], np.int64).reshape(-1, 2)
            known = merge_spans(known) if len(known) else known
            for a, e in known.tolist():
                for col, v in zip(out, (i, part, a, e, None)):
                    col.append(v)
            maybe = [r for r in rows if r["core"] is not None]
            if not maybe:
                continue
            start = np.array([r["start"] for r in maybe], np.int64)
            at = np.searchsorted(known[:, 0], start, "right") - 1
            reach = np.where(at >= 0, known[np.maximum(at, 0), 1], 0) if len(known) else np.zeros(len(start), np.int64)
            for core in {r["core"] for r, e in zip(maybe, reach.tolist()) if e < r["end"]}:
                for col, v in zip(out, (None, None, None, None, core)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                         names=["doc_id", "part", "start", "end", "core"])


def _refined(nodes: DataFrame, covered: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """One round: (covered ranges so far, nodes to refine).

    A bucket of one full class is done.  In the others, classes of several
    members are covered; a class of one may still be in part.  A bucket is
    refined if one of its nodes could cover bytes that are not covered yet,
    with one node for each class: all of them stay as partners of the rest."""
    f, size = F.xxhash64("full"), nodes.count()
    buckets = scratch(nodes.where("core is not null").groupBy("core")
                      .agg(F.count("*").alias("n"), F.min(f).alias("f_low"), F.max(f).alias("f_high"))
                      .where("n > 1").select("core", (F.col("f_low") != F.col("f_high")).alias("mixed")), f"{name}-buckets", size)
    alive = scratch(nodes.join(buckets, "core"), f"{name}-alive", size)
    mixed = alive.where("mixed").withColumn("place", F.xxhash64("doc_id", "part", "pos"))
    classes = scratch(mixed.groupBy("full").agg(F.count("*").alias("n"), F.min("place").alias("first")), f"{name}-classes", size)
    rated = scratch(mixed.join(classes, "full").where("n = 1 or place = first").drop("mixed", "first", "place"), f"{name}-rated", size)
    several = classes.where("n > 1").select("full")
    span = [(F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end")]
    none = F.lit(None).cast("binary").alias("core")
    rows = (alive.where("not mixed").select("doc_id", "part", *span, none)
            .unionByName(mixed.join(several, "full", "left_semi").select("doc_id", "part", *span, none))
            .unionByName(rated.where("n = 1").select("doc_id", "part", *span, "core")))
    rows = rows.unionByName(covered.select("doc_id", "part", "start", "end", none))
    settled = scratch(rows.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "end", "core")).alias("rows"))
                      .mapInArrow(_settle, ROUND_SCHEMA), f"{name}-settled", size)
    go_on = scratch(settled.where("core is not null").select("core").distinct(), f"{name}-needed", size)
    further = scratch(rated.join(go_on, "core", "left_semi").drop("n"), f"{name}-further", size)
    discard(nodes, alive, rated, buckets, classes, go_on)
    return settled.where("core is null").drop("core"), further


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, part, spans``: byte ranges [start, end) of the documents' texts
    that are covered by strings of ``length`` bytes which start anywhere else
    too.  ``part`` tells rows with one ``doc_id`` and unequal texts apart."""
    if length < 2 * Q:
        raise ValueError(f"length is at least {2 * Q}")
    spark = docs.sparkSession
    width = length - Q

    def roots(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids, parts = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 2))
            size = np.diff(offsets)
            (d, at), (owner, begin, end) = batch_anchors(data, offsets, length)
            buf = data.tobytes()
            low, high = np.maximum(0, length - (size[d] - at)), np.minimum(width, at)
            flat_at = at + offsets[d]
            core = [xxhash.xxh3_128_digest(buf[p:p + Q]) for p in flat_at.tolist()]
            full = [_digest(b"f%d,%d:" % (x, y), buf[p - y:p + length - x])
                    for p, x, y in zip(flat_at.tolist(), low.tolist(), high.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(core, pa.binary()), pa.array(full, pa.binary()), pa.array(ids[d]), pa.array(parts[d]), pa.array(at.astype(np.int64)),
                 pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.nulls(len(d), pa.int64())],
                names=["core", "full", "doc_id", "part", "pos", "low", "high", "end"])
            none = pa.nulls(len(owner), pa.binary())
            yield pa.RecordBatch.from_arrays(          # covered stretches: pos to end
                [none, none, pa.array(ids[owner]), pa.array(parts[owner]), pa.array(begin), pa.nulls(len(owner), pa.int32()),
                 pa.nulls(len(owner), pa.int32()), pa.array(end)],
                names=["core", "full", "doc_id", "part", "pos", "low", "high", "end"])

    root = scratch(docs.mapInArrow(roots, "core binary, full binary, doc_id long, part long, pos long, low int, high int, end long"), "anchors")
    stretches = scratch(root.where("core is null").select("doc_id", "part", F.col("pos").alias("start"), "end"), "stretches")
    covered, further = _refined(root, stretches, length, "root")
    per_doc = scratch(further.groupBy("doc_id", "part").agg(F.collect_set("pos").alias("at")), "open", further.count())
    wanted = spark.sparkContext.broadcast(bloom_of(per_doc, "doc_id", per_doc.count()))

    def only_wanted(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            yield batch.filter(pa.array(wanted.value.has(ids.view(np.uint64))))

    def first_children(batches):
        for batch in batches:
            rows = []
            for i, part, t, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                          batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                for a in places:
                    low, high = _span(a, len(t), length)
                    if low > high or a + Q > len(t):
                        continue
                    for c in children(xxhash.xxh3_128_digest(t[a:a + Q]), 0, width, low, high, t[a - high:a],
                                      t[a + Q:a + length - low], STEPS[0]):
                        rows.append((*c[:2], i, part, a, *c[2:]))
                if len(rows) > 20_000:
                    yield _node_batch(rows)
                    rows = []
            yield _node_batch(rows)

    nodes = scratch(docs.mapInArrow(only_wanted, "doc_id long, text string, part long").join(per_doc, ["doc_id", "part"])
                    .select("doc_id", "part", "text", "at").mapInArrow(first_children, NODE_SCHEMA), "nodes")
    discard(further, per_doc)
    for r, step in enumerate(STEPS[1:], 1):
        covered, further = _refined(nodes, covered, length, f"round{r}")

        def finer(batches, step=step):
            for batch in batches:
                rows = []
                for core, _, i, part, a, lo, hi, low, high, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                    rows += [(*c[:2], i, part, a, *c[2:]) for c in children(core, lo, hi, low, high, left, right, step)]
                yield _node_batch(rows)

        nodes = scratch(further.select(*_NAMES).mapInArrow(finer, NODE_SCHEMA), "nodes")
        discard(further)
    again = scratch(nodes.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "again", nodes.count())
    last = nodes.join(again, "core", "left_semi").select(
        "doc_id", "part", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end"))
    return (covered.unionByName(last).groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def substring_dedup(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and
    the removed ``spans`` as [start, end) byte ranges (``kept`` with
    ``with_text``, as binary).

    Texts are UTF-8 bytes, null text is empty; matches never cross documents.
    Every byte covered by a string of ``length`` bytes that also starts
    anywhere else, in the same document too, is removed; strings are judged on
    the input.  Rows repeated with one ``doc_id`` repeat each other's strings;
    each row is cut by the ranges of its own text.
    Rows without a ``doc_id`` are neither searched nor changed.  An empty table
    gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("part", F.xxhash64("text"))        # only told apart within one doc_id
    spans = scratch(repeated_spans(src.where("doc_id is not null"), length), "spans")
    touched = spark.sparkContext.broadcast(bloom_of(spans, "doc_id", spans.count()))
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
              + (", kept binary" if with_text else ""))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def result(batch, lists):
        out = [[] for _ in range(6)]
        for t, mine in zip(batch.column(1).cast(pa.binary()).to_pylist(), lists):
            runs = merge_spans(np.array([(s["start"], s["end"]) for s in mine], np.int64)).tolist() if mine else []
            edges = [0, *(x for r in runs for x in r), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for col, v in zip(out, (len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                                    [{"start": a, "end": b} for a, b in runs], kept)):
                col.append(v)
        arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type))]
        if with_text:
            arrays.append(pa.array(out[5], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    def has_spans(batch):
        ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
        return touched.value.has(ids.view(np.uint64)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)

    def untouched(batches):
        for batch in batches:
            rest = batch.filter(pa.array(~has_spans(batch)))
            yield result(rest, [None] * rest.num_rows)

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_spans(batch)))

    def cut(batches):
        for batch in batches:
            yield result(batch, batch.column(2).to_pylist())

    with_spans = (src.mapInArrow(maybe, "doc_id long, text string, part long").join(spans, ["doc_id", "part"], "left")
                  .select("doc_id", "text", "spans").mapInArrow(cut, schema))
    return src.mapInArrow(untouched, schema).unionByName(with_spans)
