"""Spelling variants by finite-state composition.

The vocabulary is a minimised acyclic acceptor A.  Composed with a transducer
that makes exactly one edit and with A again, it accepts the pairs of words
that differ by one inserted, deleted or replaced code point.  Before the edit
both copies of A read the same code points, so a state of the composition is
one state q of A; after it they read the same again, so what is left is what
the states on both sides of the edit have in common.  That is worked out once
for each state of A, whatever number of beginnings leads to it.

The work is dealt by initial state: words with the same first code points are
an acceptor of their own, and hold every pair that parts behind them.  A pair
that parts earlier has its last code points in common, so the reversed words
are dealt in the same way.  A beginning that too many words have is no initial
state: the edit right behind it is made in a join (what follows is equal, so a
group has at most one word for each symbol), and its words move on to longer
beginnings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, discard, is_empty, scratch as write
from .textbatch import flat, in_chunks
from .wordlists import distinct, words_where

#: Words that a task holds before it adds up their counts, and hands them on
#: if as many are left.
HELD_WORDS = 400_000
#: Bytes of a word whose checksum is taken together with the others'.
SHORT = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def checksums(seeds: np.ndarray, words: pa.Array, of: np.ndarray) -> np.ndarray:
    """crc32 of ``words[of]``, each going on from its seed."""
    data, offsets = flat(words)
    start, size = offsets[:-1][of], np.diff(offsets)[of]
    crc = ~seeds.astype(np.uint32)
    for j in range(int(min(SHORT, size.max(initial=0)))):
        on = np.flatnonzero(size > j)
        crc[on] = _CRC[(crc[on] ^ data[start[on] + j]) & 0xFF] ^ (crc[on] >> 8)
    out = ~crc
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i]:start[i] + size[i]].tobytes(), int(seeds[i]))
    return out


def _latin(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which are two bytes from C3 on."""
    two = data == 0xC3
    small = data | 0x20
    return two | np.concatenate([[False], two[:-1]]) | ((small >= 97) & (small <= 122) & (data < 128))


def _summed(words: list, counts: list) -> tuple[pa.Array, np.ndarray]:
    kinds, at = distinct(pa.concat_arrays(words))
    return kinds, np.bincount(at, np.concatenate(counts), len(kinds)).astype(np.int64)


def word_counts(docs: DataFrame, min_chars: int, one_in: int) -> DataFrame:
    """``word, n``: words of all documents, with typing errors put in by rule:
    where ``one_in`` divides the crc32 of ``<doc_id>:<word>``, the word loses
    the code point at that number modulo its length."""

    def run(batches):
        words, counts, held = [], [], 0
        for batch in batches:
            for part in in_chunks(batch, 1, 1 << 20):
                found, doc = words_where(part.column(1), _latin)
                kinds, at = distinct(found)
                pair, places = np.unique(doc * max(len(kinds), 1) + at, return_counts=True)
                of, word = pair // max(len(kinds), 1), pair % max(len(kinds), 1)
                seeds = np.array([zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in part.column(0).to_pylist()], np.uint32)
                h = checksums(seeds[of], kinds, word)
                hit = h % one_in == 0
                whole = np.bincount(word[~hit], places[~hit], len(kinds)).astype(np.int64)
                keep = (whole > 0) & (pc.utf8_length(kinds).to_numpy(zero_copy_only=False) >= min_chars)
                words.append(kinds.filter(pa.array(keep)))
                counts.append(whole[keep])
                less = []
                for w, x in zip(kinds.take(pa.array(word[hit])).to_pylist(), h[hit].tolist()):
                    less.append(w[:x % len(w)] + w[x % len(w) + 1:])
                words.append(pa.array([w for w in less if len(w) >= min_chars], pa.large_string()))
                counts.append(np.array([c for w, c in zip(less, places[hit].tolist()) if len(w) >= min_chars], np.int64))
                held += len(words[-2]) + len(words[-1])
                if held >= HELD_WORDS:
                    kinds, n = _summed(words, counts)
                    words, counts, held = [kinds], [n], len(kinds)
                    if held >= HELD_WORDS // 2:
                        yield pa.RecordBatch.from_arrays([kinds.cast(pa.string()), pa.array(n)], names=["word", "n"])
                        words, counts, held = [], [], 0
        if held:
            kinds, n = _summed(words, counts)
            yield pa.RecordBatch.from_arrays([kinds.cast(pa.string()), pa.array(n)], names=["word", "n"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Acceptor:
    """The minimised acyclic acceptor of sorted distinct words."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[str, dict[str, int], list[bool]]] = [("", {}, [False])]

        def settle(depth: int) -> None:
            while len(path) > depth:
                symbol, arcs, final = path.pop()
                key = (final[0], *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final[0])
                if path:
                    path[-1][1][symbol] = state
                else:
                    self.start = state

        last = ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            settle(same + 1)
            path.extend((c, {}, [False]) for c in w[same:])
            path[-1][2][0] = True
            last = w
        settle(0)

    def common(self, p: int, q: int, but: str = "") -> list[str]:
        """What both states accept; ``but`` is no first symbol."""
        out, todo = [], [(p, q, None)]
        while todo:
            a, b, way = todo.pop()
            if self.final[a] and self.final[b]:
                found, at = [], way
                while at:
                    found.append(at[0])
                    at = at[1]
                out.append("".join(reversed(found)))
            first, second = self.arcs[a], self.arcs[b]
            if len(first) > len(second):
                first, second = second, first
            for c in first:
                if c in second and not (way is None and c == but):
                    todo.append((first[c], second[c], (c, way)))
        return out

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Pairs of endings from ``q`` that part here by one edit: the second
        one replaces the first one's symbol by a larger one, or lacks it."""
        arcs = self.arcs[q]
        out = []
        for c, x in arcs.items():
            out += [(c + s, d + s) for d, y in arcs.items() if c < d for s in self.common(x, y)]
            # an ending that begins with c itself would part further on
            out += [(c + s, s) for s in self.common(x, q, c)]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that one edit parts, once each."""
        made: dict[int, list[tuple[str, str]]] = {}
        way: list[str] = []
        todo = [(self.start, 0, "")]
        while todo:
            q, depth, symbol = todo.pop()
            del way[max(depth - 1, 0):]
            if depth:
                way.append(symbol)
            if q not in made:
                made[q] = self.edits(q)
            if made[q]:
                head = "".join(way)
                for a, b in made[q]:
                    yield head + a, head + b
            todo.extend((x, depth + 1, c) for c, x in self.arcs[q].items())


_NEAR = "word string, n_near long, least long, form string"


def _enumerate(first: int):
    """Per word of a group, the number of its near words and the best one."""

    def settle(key, words: list[str], counts: list[int]):
        backwards, prefix = key
        n = dict(zip(words, counts))
        cut = len(prefix)
        near: dict[str, list] = {}
        for a, b in Acceptor([w[cut:] for w in words]).pairs():
            a, b = prefix + a, prefix + b
            x, y = (a[::-1], b[::-1]) if backwards else (a, b)
            if backwards and x[:first] == y[:first]:
                continue                      # found among the words with this beginning
            for w, other, m in ((x, y, n[b]), (y, x, n[a])):
                have = near.get(w)
                if have is None:
                    near[w] = [1, -m, other]
                else:
                    have[0] += 1
                    if (-m, other) < (have[1], have[2]):
                        have[1:] = -m, other
        return near

    def run(batches):
        key, words, counts = None, [], []

        def done():
            near = settle(key, words, counts) if len(words) > 1 else {}
            return pa.RecordBatch.from_arrays(
                [pa.array(list(near), pa.string()), *[pa.array([v[i] for v in near.values()], t) for i, t in
                                                      enumerate((pa.int64(), pa.int64(), pa.string()))]],
                names=["word", "n_near", "least", "form"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if words:
                        yield done()
                    key, words, counts = row[:2], [], []
                words.append(row[2])
                counts.append(row[3])
        if words:
            yield done()

    return run


def near_words(vocabulary: DataFrame, min_chars: int, group_words: int, scratch: Scratch) -> DataFrame:
    """``word, n_near, form, form_n``: for each word with near words their
    number and the one of largest n, of several the smallest."""
    first = min_chars // 2
    both = vocabulary.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("backwards"), "word", "n")
    both = both.withColumn("way", F.when(F.col("backwards"), F.reverse("word")).otherwise(F.col("word")))
    groups, joined, depth = [], [], first
    while True:
        keyed = both.withColumn("prefix", F.substring("way", 1, depth))
        hot = scratch(keyed.groupBy("backwards", "prefix").count().where(F.col("count") > group_words)
                      .select("backwards", "prefix"), "spelling-hot")
        if is_empty(hot):
            groups.append(keyed)
            break
        groups.append(keyed.join(hot, ["backwards", "prefix"], "left_anti").select(*keyed.columns))
        both = scratch(keyed.join(hot, ["backwards", "prefix"], "left_semi").select(*keyed.columns), "spelling-long")
        # the symbol behind the beginning is read by one side, by both in different ways, or by none
        rest = F.expr(f"substring(way, {depth + 1})")
        ends = both.where(F.char_length("way") > depth).select(
            "backwards", "prefix", F.expr(f"substring(way, {depth + 2})").alias("rest"), F.expr(f"substring(way, {depth + 1}, 1)").alias("symbol"), "word", "n")
        ends = scratch(ends.unionByName(both.select("backwards", "prefix", rest.alias("rest"), F.lit("").alias("symbol"), "word", "n")), "spelling-ends")
        x, y = ends.alias("x"), ends.select("backwards", "prefix", "rest", *[F.col(c).alias(f"o_{c}") for c in ("symbol", "word", "n")])
        same = (F.col("symbol") == F.col("o_symbol")) | (F.greatest("symbol", "o_symbol") == F.substring("rest", 1, 1)) & (F.least("symbol", "o_symbol") == "")
        found = F.col("backwards") & (F.substring("word", 1, first) == F.substring("o_word", 1, first))
        joined.append(x.join(y, ["backwards", "prefix", "rest"]).where(~same & ~found).groupBy("word")
                      .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("least"), F.col("o_word").alias("form"))).alias("b"))
                      .select("word", "n_near", "b.least", "b.form"))
        depth += 1
        both = both.drop("prefix")
    near = None
    for g in groups:
        part = (g.select("backwards", "prefix", "way", "n").repartition("backwards", "prefix")
                .sortWithinPartitions("backwards", "prefix", "way").mapInArrow(_enumerate(first), _NEAR))
        near = part if near is None else near.unionByName(part)
    for j in joined:
        near = near.unionByName(j)
    return (near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("least", "form")).alias("b"))
            .select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.least")).alias("form_n")))


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``, in which every form is more
    frequent than its word: each round follows twice as many steps."""
    now = write(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not is_empty(now.where("moved")):
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        nxt = write(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"),
                                                       F.col("above").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = nxt
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, min_chars: int = 6, least: int = 5, times: int = 5, one_in: int = 199,
                    group_words: int = 20_000) -> DataFrame:
    """Per word of at least ``min_chars`` code points and ``least`` occurrences:
    ``word, n, n_near, form, form_n, root``.

    ``form`` is the near word of largest n (of several the smallest) if that n
    is at least ``times`` the word's own, else null; ``root`` follows the forms
    to the last.  Null and empty texts have no words; rows repeated with one
    ``doc_id`` all count, a null ``doc_id`` counts as empty in the rule for
    typing errors; an empty table gives an empty result; other columns are not
    read.  ``group_words`` bounds the words of one acceptor, not the result."""
    scratch = Scratch()
    vocabulary = write(word_counts(docs, min_chars, one_in).where(F.col("n") >= least), "spelling-words")
    near = write(near_words(vocabulary, min_chars, group_words, scratch), "spelling-near")
    scratch.clear()
    forms = (vocabulary.join(near, "word", "left")
             .withColumn("holds", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
             .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                     F.when(F.col("holds"), F.col("form")).alias("form"), F.when(F.col("holds"), F.col("form_n")).alias("form_n")))
    roots = last_forms(forms.where("form is not null"))
    return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
