"""Brute-force versions of the text operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line_dedup(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs
                or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def substring_dedup(docs, length):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[a:a + length] for i, t in texts if i is not None for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if i is not None and seen[t[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for a in range(len(t)) if gone[a] and (a == 0 or not gone[a - 1]))
        out.append((i, len(t), sum(gone), runs, sha(kept)))
    return out


def exact_dedup(docs):
    norm = [(i, SPACES.sub(" ", t or "")) for i, t in docs]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, sha(t)))
    return out


def word_sets(docs, k):
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def jaccard_components(docs, k, percent):
    sets = word_sets(docs, k)
    nodes = [(i, s) for i, s in sets if i is not None]
    parent = {i: i for i, _ in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (a, x) in enumerate(nodes):
        for b, y in nodes[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def decontaminate(docs, items, k=5, percent=80):
    out = set()
    merged = defaultdict(list)
    for i, t in docs:
        if i is not None:
            merged[i].append(WORD.findall((t or "").translate(LOWER)))
    for j, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        kk = min(k, len(w))
        if j is None or not kk:
            continue
        item = {tuple(w[a:a + kk]) for a in range(len(w) - kk + 1)}
        for i, texts in merged.items():
            doc = {tuple(x[a:a + kk]) for x in texts for a in range(len(x) - kk + 1)}
            if len(doc & item) * 100 >= len(item) * percent:
                out.add((i, j, len(item), len(doc & item)))
    return out


def license_base(docs, phrases):
    out = []
    for i, t in docs:
        w = LICENSE_WORD.findall((t or "").translate(LOWER))
        places, labels = [], set()
        for label, phrase in phrases:
            p = phrase.split()
            at = [a for a in range(len(w) - len(p) + 1) if w[a:a + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return out
