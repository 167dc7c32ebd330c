"""Hierarchical multi-length packing.

A document's tokens are cut into full windows of ``max_len``; what is left is
routed to the smallest of several context-size tiers that holds it.  Each tier
is packed from long to short: a window opens with a document of its own tier,
its gap is filled with the longest documents of shorter tiers that fit, and
the last gap with a cut of one more document, so windows are exactly full.
What cannot fill a window of the shortest tier at the end of a task is cut
into powers of two.  Windows are dealt, longest first, to step groups of equal
token numbers.

The work needs no shuffle: tokens never leave the task that made them, a task
packs pools of bounded size, and the result has a row per piece.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import flat, in_chunks, word_hashes, word_spans

#: Words whose ids a worker keeps (about 40 bytes each); beyond, the half that
#: was used longest ago is dropped.
CACHE_WORDS = 1_500_000
#: Words worked on at a time.
BLOCK_WORDS = 500_000
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
                "sequence_length long, tier long, step_group long")


_MARKED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")


class WordIds:
    """Token ids of texts.

    The tokenizer drops white space, merges nothing across it and lower-cases,
    so a text's ids are those of its white-space separated words with A-Z
    lower-cased; a word and the ASCII marks after it are split too, except at
    an apostrophe.  The ids of words seen are kept in arrays sorted by the
    words' 64-bit hashes, so texts are turned into ids by look-ups of whole
    blocks; new words made of letters alone are encoded many at a time by the
    same model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.hashes = np.zeros(0, np.uint64)        # sorted; the other arrays go with it
        self.start = np.zeros(0, np.int64)          # in the pool
        self.size = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)           # the last block that had the word
        self.pool = np.zeros(0, "<u4")
        self.block = 0

    @staticmethod
    def _plain(word: bytes) -> str | None:
        w = word.decode("utf-8", "replace")
        return w if w.isalpha() and w.lower().isalpha() and (w.isascii() or unicodedata.is_normalized("NFC", w)) else None

    def _by_tokenizer(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct lower-case words."""
        out: list = [None] * len(words)
        plain = [(i, p) for i, w in enumerate(words) if (p := self._plain(w)) is not None]
        for i in range(0, len(plain), 50_000):
            some = plain[i:i + 50_000]
            found = self.letters.encode_batch_fast([" ".join(p for _, p in some[j:j + 500]) for j in range(0, len(some), 500)],
                                                   add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("words and word ends differ")
            a = 0
            for (k, _), e in zip(some, ends.tolist()):
                out[k] = ids[a:e]
                a = e
        other = [i for i, x in enumerate(out) if x is None]
        for i in range(0, len(other), 20_000):
            some = other[i:i + 20_000]
            found = self.tokenizer.encode_batch_fast([words[k].decode("utf-8", "replace") for k in some], add_special_tokens=False)
            for k, e in zip(some, found):
                out[k] = np.array(e.ids, "<u4")
        return out

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is known) of sorted or unsorted hashes."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def _add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in ids], np.int32)
        start = len(self.pool) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.pool = np.concatenate([self.pool, *ids])
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")       # two sorted runs
        self.hashes = merged[order]
        self.start = np.concatenate([self.start, start])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.used = np.concatenate([self.used, np.full(len(ids), self.block, np.int32)])[order]

    def _shrink(self) -> None:
        keep = self.used > np.median(self.used)
        size = self.size[keep]
        self.pool = self.pool[_ranges(self.start[keep], size)]
        self.hashes, self.used, self.size = self.hashes[keep], self.used[keep], size
        self.start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """New distinct lower-case words, in the order of their hashes."""
        marked = [(m[1], m[2]) if (m := _MARKED.fullmatch(w)) and self._plain(m[1]) else None for w in words]
        parts = {x for m in marked if m for x in m}.difference(w for w, m in zip(words, marked) if not m)
        if parts:           # words without their marks may be known
            parts = list(parts)
            data = np.frombuffer(b" ".join(parts), np.uint8)
            h = word_hashes(data, *word_spans(data, np.array([0, len(data)]))[:2])
            at, known = self._find(h)
            ids = {p: self.pool[self.start[a]:self.start[a] + self.size[a]] for p, a, k in zip(parts, at.tolist(), known.tolist()) if k}
        else:
            ids, h = {}, np.zeros(0, np.uint64)
        hash_of = dict(zip(parts, h.tolist()))
        new_parts = [p for p in parts if p not in ids]
        alone = [w for w, m in zip(words, marked) if not m]
        for w, x in zip(new_parts + alone, self._by_tokenizer(new_parts + alone)):
            ids[w] = x
        found = [np.concatenate([ids[m[0]], ids[m[1]]]) if m else ids[w] for w, m in zip(words, marked)]
        extra = sorted((hash_of[p], p) for p in new_parts)
        if extra:
            self._add(np.array([x for x, _ in extra], np.uint64), [ids[p] for _, p in extra])
        self._add(hashes, found)

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of a block of words."""
        self.block += 1
        if len(self.hashes) > CACHE_WORDS:
            self._shrink()
        h = word_hashes(data, starts, ends)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        _, known = self._find(uniq)
        new = first[~known]
        if len(new):
            self._learn([data[a:b].tobytes().lower() for a, b in zip(starts[new].tolist(), ends[new].tolist())], uniq[~known])
        at, _ = self._find(uniq)
        self.used[at] = self.block
        size = self.size[at][back]
        return self.pool[_ranges(self.start[at][back], size)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Each document's ids."""
        starts, ends, counts = word_spans(data, offsets)
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for i in range(0, len(starts), BLOCK_WORDS):
            x, n = self._encode_words(data, starts[i:i + BLOCK_WORDS], ends[i:i + BLOCK_WORDS])
            ids.append(x)
            sizes.append(n)
        ids = np.concatenate(ids)
        words = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        cut = words[np.concatenate([[0], np.cumsum(counts)])]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else ()
        for d in np.unique(np.searchsorted(offsets, special, "right") - 1) if len(special) else ():
            # strings of special tokens may be in it: it goes to the tokenizer as it is
            text = data[offsets[d]:offsets[d + 1]].tobytes().decode("utf-8", "replace")
            out[d] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class Pool:
    """Remainders of documents by tier, shorter than the longest window."""

    def __init__(self, tiers: list[int]):
        self.tiers = sorted(tiers)                   # e.g. 256, 512, 1024, 2048
        self.rest: dict[int, dict[int, list]] = {t: defaultdict(list) for t in self.tiers}
        self.lengths: dict[int, list[int]] = {t: [] for t in self.tiers}   # sorted keys of rest[t]
        self.tokens = 0

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def put(self, piece: tuple) -> None:
        n, t = piece[2], self.tier(piece[2])
        if n not in self.rest[t]:
            keys = self.lengths[t]
            keys.insert(bisect_right(keys, n), n)
        self.rest[t][n].append(piece)
        self.tokens += n

    def take(self, tier: int, most: int):
        """The longest piece of a tier with at most ``most`` tokens."""
        keys = self.lengths[tier]
        i = bisect_right(keys, most)
        if not i:
            return None
        n = keys[i - 1]
        piece = self.rest[tier][n].pop()
        if not self.rest[tier][n]:
            del self.rest[tier][n]
            keys.pop(i - 1)
        self.tokens -= n
        return piece

    def shortest(self):
        for t in self.tiers:
            if self.lengths[t]:
                return self.take(t, t)
        return None


def _cut(piece: tuple, n: int):
    doc, start, _, ids, total = piece
    return (doc, start, n, ids[:4 * n], total), (doc, start + n, piece[2] - n, ids[4 * n:], total)


def pack_pool(pool: Pool, final: bool):
    """Yield (tier, [pieces]) of full windows.  Unless ``final``, a tier stops
    when the pool cannot fill its window any more."""
    for window in reversed(pool.tiers):
        while pool.lengths[window] and pool.tokens >= window:
            pieces = [pool.take(window, window)]
            gap = window - pieces[0][2]
            for shorter in reversed([t for t in pool.tiers if t <= window]):
                while gap and (p := pool.take(shorter, gap)):
                    pieces.append(p)
                    gap -= p[2]
            if gap:                                  # every piece left is longer than the gap
                a, b = _cut(pool.shortest(), gap)
                pieces.append(a)
                pool.put(b)
            yield window, pieces
    if final:
        left = []
        while (p := pool.shortest()):
            left.append(p)
        while left:
            n = sum(p[2] for p in left)
            window, need, pieces = 1 << (n.bit_length() - 1), 1 << (n.bit_length() - 1), []
            while need:
                p = left.pop()
                if p[2] > need:
                    p, b = _cut(p, need)
                    left.append(b)
                pieces.append(p)
                need -= p[2]
            yield window, pieces


class _Out:
    """Numbers windows and deals them to step groups of equal token numbers:
    windows are powers of two, so taken longest first they fill a group of
    ``step_tokens`` exactly."""

    def __init__(self, base: int, step_tokens: int, text_ids: bool):
        self.sequence = self.group = base
        self.step_tokens, self.fill, self.text_ids = step_tokens, 0, text_ids

    def batch(self, windows: list[tuple[int, list]]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(10)]
        for tier, pieces in sorted(windows, key=lambda w: -w[0]):
            if self.fill + tier > self.step_tokens:
                self.group, self.fill = self.group + 1, 0
            self.fill += tier
            offset, total = 0, sum(p[2] for p in pieces)
            for doc, start, n, ids, doc_tokens in pieces:
                for c, v in zip(cols, (doc, start, n, zlib.crc32(ids), doc_tokens, self.sequence, offset, total, tier, self.group)):
                    c.append(v)
                offset += n
            self.sequence += 1
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = 2048,
         tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, pool_tokens: int = 4_000_000,
         step_tokens: int = 1 << 16) -> DataFrame:
    """Pack all of ``docs`` (``doc_id, text``) into sequences; a row per piece:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and
    ``sequence_length, tier, step_group``.

    A document is its ids and ``end_id``; null or empty text is ``end_id``
    alone.  Every id lies in exactly one piece.  All sequences are full: their
    lengths are powers of two up to ``max_len``.  Rows repeated with one
    ``doc_id``, and rows without one, are documents of their own.  An empty
    table gives an empty result; other columns are not read.  ``pool_tokens``
    bounds what a task holds back for packing; ``tokenizer_path`` defaults to
    ``word_bpe_49k.json`` of the tokenizer files."""
    if max_len != max(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two, the largest is max_len")
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        coder = word_ids(tokenizer_path)
        out = _Out(TaskContext.get().partitionId() << 40, step_tokens, False)
        pool, full = Pool(list(tiers)), []
        for batch in batches:
            for part in in_chunks(batch, 1):
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode(*flat(part.column(1)))):
                    ids = ids.tobytes() + end
                    total = len(ids) // 4
                    whole = total - total % max_len
                    for i in range(0, whole, max_len):
                        full.append((max_len, [(doc, i, max_len, ids[4 * i:4 * (i + max_len)], total)]))
                    if whole < total:
                        pool.put((doc, whole, total - whole, ids[4 * whole:], total))
                if pool.tokens >= pool_tokens:
                    full += pack_pool(pool, False)
                if len(full) >= 512:
                    yield out.batch(full)
                    full = []
        full += pack_pool(pool, True)
        for i in range(0, len(full), 4096):
            yield out.batch(full[i:i + 4096])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)
