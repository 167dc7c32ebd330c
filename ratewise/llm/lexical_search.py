"""Ranked lexical search by a dual tree over items and documents.

Items and documents are vectors over the items' terms: an item holds
``count * weight`` of each of its terms, a document the damped share of the
term in it, and the score of a pair is their inner product.  Both sides get a
hierarchy whose nodes hold the largest value of each coordinate below them, so
the product of two nodes' maxima bounds the score of every pair below.  A pair
of nodes whose bound is under the weakest k-th score of the node's items is
left out with all the pairs below it; no pair that could enter a list is.

Spark deals the documents over tasks; a task builds the tree of a block of
documents at a time and keeps the best k of each item over its blocks.  A
first round searches one block of each task; the k-th scores found there hold
for every task of the second round, which searches all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .textbatch import flat, in_chunks, word_hashes
from .wordlists import outside, runs

_LETTERS = outside([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Documents below one leaf, children of a node, documents of a block.
LEAF, FAN, BLOCK_DOCS = 16, 8, 4096
#: Values that the leaves of one block's tree hold at most.
BLOCK_CELLS = 4_000_000
#: Leaves scored at a time, the most promising ones first.
AT_ONCE = 16


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, and for its distinct terms: text number, hash, count)."""
    data, offsets = flat(column)
    starts, ends, doc = runs(_LETTERS(data), offsets)
    h = word_hashes(data, starts, ends).view(np.int64)
    n = np.bincount(doc, minlength=len(column)).astype(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return n, doc[new], h[new], np.diff(np.append(new, len(h)))


def item_terms(items: DataFrame) -> DataFrame:
    """``item_key, item_id, term, c``: an item is a row."""

    def run(batches):
        for batch in batches:
            for part in in_chunks(batch, 2, 1 << 20):
                _, row, term, c = term_counts(part.column(2))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(term), pa.array(c.astype(np.int64))],
                                                 names=["item_key", "item_id", "term", "c"])

    return (items.select(F.monotonically_increasing_id().alias("item_key"), F.col("item_id").cast("long").alias("item_id"),
                         F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "item_key long, item_id long, term long, c long"))


def forward_table(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, tfs``: all terms of a document counted, those of the
    vocabulary listed by their number in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)     # one batch's terms, at most batch_terms

    def run(batches):
        words = shared.value
        low = np.zeros(1 << 16, bool)
        low[words & 0xFFFF] = True
        for batch in batches:
            for part in in_chunks(batch, 1, 1 << 20):
                n, doc, h, c = term_counts(part.column(1))
                maybe = np.flatnonzero(low[h & 0xFFFF])
                at = np.minimum(np.searchsorted(words, h[maybe]), max(len(words) - 1, 0))
                hit = words[at] == h[maybe] if len(words) else np.zeros(0, bool)
                chosen = maybe[hit]
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[chosen], minlength=part.num_rows))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.ListArray.from_arrays(cuts, pa.array(at[hit].astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(c[chosen].astype(np.int64)))], names=["doc_id", "n", "terms", "tfs"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False), np.asarray(c.offsets) - c.offsets[0].as_py()


def corpus_statistics(forward: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term) over all documents."""

    def run(batches):
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(_lists(batch.column(1))[0], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[docs, total], df[some]]))],
                                         names=["term", "n"])

    sums = forward.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(sums["term"].tolist(), sums["n"].tolist()))
    df = np.array([by.get(t, 0) for t in range(n_terms)], np.int64)
    return by.get(-2, 0), by.get(-1, 0), df


@dataclass
class Node:
    items: np.ndarray              # numbers of the items below
    terms: np.ndarray
    most: np.ndarray               # largest value of each of the terms
    children: list = field(default_factory=list)


class Items:
    """The items' vectors and their hierarchy: items with the same strongest
    term stand together."""

    def __init__(self, of: np.ndarray, terms: np.ndarray, values: np.ndarray, n_items: int):
        keep = values > 0
        order = np.lexsort((terms[keep], of[keep]))
        of, self.terms, self.values = of[keep][order], terms[keep][order], values[keep][order]
        self.cuts = np.searchsorted(of, np.arange(n_items + 1))
        top = np.full(n_items, -1)
        strongest = np.lexsort((self.values, of))
        top[of[strongest]] = self.terms[strongest]
        level = [Node(np.array([i]), self.terms[a:b], self.values[a:b])
                 for i in np.argsort(top, kind="stable").tolist()
                 for a, b in [self.cuts[i:i + 2]] if b > a]
        while len(level) > 1:
            level = [self._above(level[i:i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0] if level else None

    @staticmethod
    def _above(nodes: list[Node]) -> Node:
        terms, at = np.unique(np.concatenate([n.terms for n in nodes]), return_inverse=True)
        most = np.zeros(len(terms), np.int64)
        np.maximum.at(most, at, np.concatenate([n.most for n in nodes]))
        return Node(np.concatenate([n.items for n in nodes]), terms, most, nodes)


class Block:
    """A block of documents and its tree, from the top level to the leaves."""

    def __init__(self, ids, cuts, terms, values, n_terms: int, weights: np.ndarray):
        # documents with the same strongest terms stand together
        gain = weights[terms] * values
        of = np.repeat(np.arange(len(ids)), np.diff(cuts))
        by = np.lexsort((-gain, of))
        first, second = np.full(len(ids), -1), np.full(len(ids), -1)
        some = np.diff(cuts) > 0
        first[some] = terms[by][cuts[:-1][some]]
        more = np.diff(cuts) > 1
        second[more] = terms[by][cuts[:-1][more] + 1]
        order = np.lexsort((second, first))
        size = np.diff(cuts)[order]
        self.ids, self.cuts = ids[order], np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(cuts[:-1][order] - self.cuts[:-1], size) + np.arange(int(size.sum()))
        self.terms, self.values = terms[source], values[source]
        used = np.unique(self.terms)
        self.column = np.full(n_terms, -1)
        self.column[used] = np.arange(len(used))
        self.leaf = max(LEAF, -(-len(ids) * max(len(used), 1) // BLOCK_CELLS))
        n_leaves = -(-len(ids) // self.leaf)
        level = np.zeros((n_leaves, len(used)))
        where = np.repeat(np.arange(len(ids)) // self.leaf, size)
        np.maximum.at(level, (where, self.column[self.terms]), self.values)
        self.levels = [level]
        while len(self.levels[0]) > 1:
            below = self.levels[0]
            pad = -len(below) % FAN
            grown = np.concatenate([below, np.zeros((pad, below.shape[1]))]) if pad else below
            self.levels.insert(0, grown.reshape(-1, FAN, below.shape[1]).max(axis=1))

    def bounds(self, depth: int, nodes: np.ndarray, node: Node) -> np.ndarray:
        """Upper bounds of the scores between the document nodes and the item
        node; the factor covers rounding in the sums."""
        c = self.column[node.terms]
        have = c >= 0
        return (self.levels[depth][np.ix_(nodes, c[have])] @ node.most[have].astype(np.float64)) * (1 + 1e-9)

    def children(self, depth: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return below[below < len(self.levels[depth + 1])]


class Search:
    """The best ``k`` documents of each item over the blocks of a task."""

    def __init__(self, items: Items, n_items: int, n_terms: int, k: int, floor: np.ndarray):
        self.items, self.k = items, k
        self.floor = floor.astype(np.int64)                  # a document must reach it
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n_items)]
        self.dense = np.zeros(n_terms, np.int64)
        self.bounds = self.scored = 0

    def add(self, block: Block) -> None:
        if self.items.root is not None and len(block.ids):
            self._visit(self.items.root, block, 0, np.arange(len(block.levels[0])))

    def _visit(self, node: Node, block: Block, depth: int, nodes: np.ndarray) -> None:
        bound = block.bounds(depth, nodes, node)
        self.bounds += len(nodes)
        # an equal score may still enter by a smaller id
        keep = (bound >= self.floor[node.items].min()) & (bound > 0)
        nodes = nodes[keep]
        if not len(nodes):
            return
        leaf = depth == len(block.levels) - 1
        if not node.children and leaf:
            self._score(int(node.items[0]), block, nodes, bound[keep])
            return
        below = nodes if leaf else block.children(depth, nodes)
        for child in node.children or [node]:
            self._visit(child, block, depth if leaf else depth + 1, below)

    def _score(self, item: int, block: Block, leaves: np.ndarray, bound: np.ndarray) -> None:
        order = np.argsort(-bound, kind="stable")
        leaves, bound = leaves[order], bound[order]
        a, b = self.items.cuts[item:item + 2]
        terms = self.items.terms[a:b]
        self.dense[terms] = self.items.values[a:b]
        for i in range(0, len(leaves), AT_ONCE):
            part = leaves[i:i + AT_ONCE][bound[i:i + AT_ONCE] >= self.floor[item]]
            if not len(part):
                break
            docs = (part[:, None] * block.leaf + np.arange(block.leaf)).ravel()
            docs = docs[docs < len(block.ids)]
            size = block.cuts[docs + 1] - block.cuts[docs]
            docs, size = docs[size > 0], size[size > 0]
            if not len(docs):
                continue
            heads = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(block.cuts[docs] - heads[:-1], size) + np.arange(heads[-1])
            score = np.add.reduceat(self.dense[block.terms[at]] * block.values[at], heads[:-1])
            self.scored += len(docs)
            hit = (score > 0) & (score >= self.floor[item])
            if hit.any():
                ids, scores = (np.concatenate(x) for x in zip(self.best[item], (block.ids[docs[hit]], score[hit])))
                top = np.lexsort((ids, -scores))[:self.k]
                self.best[item] = ids[top], scores[top]
                if len(top) == self.k:
                    self.floor[item] = max(self.floor[item], scores[top[-1]])
        self.dense[terms] = 0


def document_value(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The damped share of a term: 64-bit integers, rounded down."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        m = np.array([75 + 25 * x * docs // total for x in n.tolist()], np.int64)
    else:
        m = 75 + 25 * n * docs // max(total, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _blocks(batches, docs: int, total: int, n_terms: int, weights: np.ndarray) -> Iterator[Block]:
    held, rows = [], 0

    def build():
        ids, n, size, terms, tfs = (np.concatenate(x) for x in zip(*held))
        values = document_value(tfs, np.repeat(n, size), docs, total)
        return Block(ids, np.concatenate([[0], np.cumsum(size)]), terms, values, n_terms, weights)

    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        for i in range(0, batch.num_rows, BLOCK_DOCS // 4):
            part = batch.slice(i, BLOCK_DOCS // 4)
            terms, cuts = _lists(part.column(2))
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), np.diff(cuts), terms, _lists(part.column(3))[0]))
            rows += part.num_rows
            if rows >= BLOCK_DOCS:
                yield build()
                held, rows = [], 0
    if rows:
        yield build()


def _search_batch(docs: DataFrame, batch: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    rows = batch.select("item_key", "term", "c").orderBy("item_key", "term").toPandas()     # at most batch_terms rows, or one item's
    keys, of = np.unique(rows["item_key"].to_numpy(), return_inverse=True)
    vocabulary, number = np.unique(rows["term"].to_numpy(), return_inverse=True)
    n_items, n_terms = len(keys), len(vocabulary)
    forward = scratch(forward_table(docs, vocabulary), "search-forward")
    n_docs, total, df = corpus_statistics(forward, n_terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    items = Items(of, number, rows["c"].to_numpy().astype(np.int64) * weights[number], n_items)
    shared = spark.sparkContext.broadcast((items, weights))

    def run(floor, first_only):
        def search(batches):
            tree, w = shared.value
            found = Search(tree, n_items, n_terms, k, floor.value if floor else np.zeros(n_items, np.int64))
            for block in _blocks(batches, n_docs, total, n_terms, w):
                found.add(block)
                if first_only:
                    break
            size = [len(ids) for ids, _ in found.best]
            if sum(size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(n_items, dtype=np.int32), size)), *[pa.array(np.concatenate(c)) for c in zip(*found.best)]],
                    names=["item", "doc_id", "score"])
        return forward.mapInArrow(search, "item int, doc_id long, score long")

    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    # one number for each item of the batch
    weakest = ranked(run(None, True)).where(F.col("rank") == k).select("item", "score").toPandas()
    floor = np.zeros(n_items, np.int64)
    floor[weakest["item"].to_numpy()] = weakest["score"].to_numpy()
    best = ranked(run(spark.sparkContext.broadcast(floor), False))
    ids = (spark.createDataFrame([(i, int(x)) for i, x in enumerate(keys)], "item int, item_key long")
           .join(batch.select("item_key", "item_id").distinct(), "item_key").select("item", "item_id"))
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, batch_terms: int = 500_000) -> DataFrame:
    """The ``k`` highest-scoring documents of each row of ``items``:
    ``item_id, rank, doc_id, score``, with scores above 0 only and equal ones by
    ascending ``doc_id``.

    Null or empty texts have no terms: such items have no rows in the result,
    such documents are not counted.  Each row is an item or a document of its
    own, also if ids repeat (equal scores of one id get ranks in any order,
    with the same values); documents without an id count in the statistics,
    but are not ranked.  Empty tables give an empty result; other columns are
    not read.  Items are taken in batches of some ``batch_terms`` distinct
    terms, which is what a task holds of them; each batch searches all
    documents."""
    spark = docs.sparkSession
    scratch = Scratch()
    terms = scratch(item_terms(items), "search-items")
    n_batches = max(1, -(-terms.count() // batch_terms))
    found = None
    for b in range(n_batches):
        batch = terms.where(F.pmod(F.xxhash64("item_key"), F.lit(n_batches)) == b)
        part = _search_batch(docs, batch, k, scratch)
        found = part if found is None else found.unionByName(part)
    return found
