"""Spelling variants, ranked search and toxicity against brute-force versions,
on awkward fixtures (null ids and texts, empty and very long texts, repeated
rows, ties, clashing extra columns) and on empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ratewise.llm import lexical_search as S
from ratewise.llm import toxicity as X
from ratewise.llm.passages import shared_passages
from ratewise.llm.spelling import Acceptor, checksums, spelling_groups

LOWER = {i: i + 32 for i in range(65, 91)}
EXTRA = "word string, prefix string, n long, terms string, item string, score double, x string, `lost.id` string"


def frame(spark, docs, key="doc_id"):
    schema = f"{key} long, text string, " + EXTRA
    return spark.createDataFrame([(i, t, "w", "p", 1, "t", "i", 0.5, "x", "l") for i, t in docs], schema).repartition(3)


# ------------------------------------------------------------------- spelling
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(docs, min_chars=6, least=5, times=5, one_in=199):
    n = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= least}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def spelling_docs():
    rng = random.Random(3)
    letters = "abcé×"
    vocab = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(250)}
    for w in list(vocab)[:120]:
        p = rng.randrange(len(w))
        vocab.add(w[:p] + rng.choice(letters) + w[p + rng.randint(0, 1):])
    vocab |= {"a" * k for k in range(5, 12)} | {"aaaaaab", "baaaaaa", "aaabaaa", "ÀÉabcdef", "àÉabcdef"}
    long = "".join(rng.choice("xyz") for _ in range(3000))
    vocab |= {long, long[:1500] + long[1501:], long[:7] + "q" + long[8:]}
    vocab = sorted(vocab)
    weight = [rng.choice([1, 1, 1, 8, 50]) for _ in vocab]
    docs = []
    for i in range(150):
        words = rng.choices(vocab, weight, k=rng.randint(1, 200))
        docs.append((i, " 7".join(w.upper() if rng.random() < .1 and w.isascii() else w for w in words)))
    for i in range(150, 156):
        docs.append((i, " ".join([long, long[:1500] + long[1501:], long[:7] + "q" + long[8:], "Straße", "straÿe"])))
    for i in range(156, 200):                            # a chain of forms
        docs.append((i, "chainbb " * 12 + "chainab " + ("chainaa " if i < 162 else "") + "chainbb"))
    return docs + [(None, docs[0][1]), (None, None), (500, None), (501, ""), (502, "1 2 3 _"), docs[4], docs[4]]


@pytest.mark.parametrize("group_words,one_in", [(20_000, 199), (4, 7)])
def test_spelling(spark, group_words, one_in):
    docs = spelling_docs()
    got = spelling_groups(frame(spark, docs), group_words=group_words, one_in=one_in)
    rows = [tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    want = brute_spelling(docs, one_in=one_in)
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert sum(r[3] is not None for r in want) > 10 and any(r[3] and r[5] != r[3] for r in want)


def test_spelling_empty(spark):
    got = spelling_groups(frame(spark, []))
    assert got.count() == 0 and dict(got.dtypes)["form_n"] == "bigint" and dict(got.dtypes)["n_near"] == "bigint"


def test_acceptor_is_minimal_and_pairs_are_complete():
    words = sorted({"ab", "abc", "abd", "b", "bc", "bd", "aab", "", "cab", "cabc", "cabd"})
    a = Acceptor(words)
    right = {(w[i:], tuple(sorted(x[len(w[:i]):] for x in words if x.startswith(w[:i])))) for w in words for i in range(len(w) + 1)}
    assert len(a.arcs) == len({r for _, r in right})          # a state for each right language
    got = [frozenset(p) for p in a.pairs()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((x, y)) for x in words for y in words if x < y and one_edit(x, y)}


def test_checksums():
    words = ["a", "bcd", "é" * 50, "x" * 64, "x" * 65]
    seeds = np.array([zlib.crc32(b"7:"), zlib.crc32(b":")], np.uint32)
    of = np.repeat(np.arange(5), 2)
    got = checksums(np.tile(seeds, 5), pa.array(words, pa.large_string()), of)
    assert got.tolist() == [zlib.crc32((p + w).encode()) for w in words for p in ("7:", ":")]


# --------------------------------------------------------------------- search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    terms = [(i, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in terms)
    total = sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = Counter()
    for item_id, t in items:
        q = Counter(w.translate(LOWER) for w in TERM.findall(t or ""))
        scored = []
        for i, c in terms:
            if i is None or not c:
                continue
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
                    for w, x in q.items() if c[w])
            if s > 0:
                scored.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out[item_id, rank, i, -s] += 1
    return out


def search_tables():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcéñ0") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    pick = lambda n: " ".join(rng.choices(vocab, [1 / (r + 1) for r in range(300)], k=n))
    docs = [(i, pick(rng.randint(1, 80))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(1000, 1060)]                 # ties
    docs += [(2000, pick(30_000)), (2001, ""), (2002, None), (2003, "-- ."), (None, docs[3][1]), (None, None), docs[9], docs[9],
             (2004, "A-b_C ſ K straße"), (-5, docs[7][1].upper())]
    rng.shuffle(docs)
    items = [(i, pick(rng.randint(1, 25))) for i in range(40)]
    items += [(100, docs[20][1]), (101, ""), (102, None), (103, "unheard of"), (104, "ſ k STRAßE a a a"), (None, vocab[5]), items[3], items[3]]
    return docs, items


@pytest.mark.parametrize("k,batch_terms", [(20, 500_000), (3, 150)])
def test_search(spark, k, batch_terms):
    docs, items = search_tables()
    got = S.ranked_search(frame(spark, docs), frame(spark, items, "item_id"), k=k, batch_terms=batch_terms)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(docs, items, k)


def test_search_empty(spark):
    docs, items = search_tables()
    none = frame(spark, [])
    for d, i in ((none, frame(spark, items, "item_id")), (frame(spark, docs[:5]), frame(spark, [], "item_id"))):
        got = S.ranked_search(d, i)
        assert got.count() == 0 and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_tree_prunes_exactly(monkeypatch):
    monkeypatch.setattr(S, "LEAF", 2)
    monkeypatch.setattr(S, "FAN", 3)
    rng = np.random.default_rng(5)
    n_docs, n_items, n_terms, k = 500, 30, 60, 4
    dense = (rng.random((n_docs, n_terms)) < .05) * rng.integers(1, 1000, (n_docs, n_terms))
    dense[50:90] = dense[3]
    ids = rng.permutation(n_docs)
    query = (rng.random((n_items, n_terms)) < .1) * rng.integers(1, 50, (n_items, n_terms))
    of, terms = np.nonzero(query)
    items = S.Items(of, terms, query[of, terms], n_items)
    search = S.Search(items, n_items, n_terms, k, np.zeros(n_items, np.int64))
    for part in np.array_split(np.arange(n_docs), 3):
        d, t = np.nonzero(dense[part])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(part)))])
        search.add(S.Block(ids[part], cuts, t, dense[part][d, t], n_terms, np.ones(n_terms, np.int64)))
    score = query @ dense.T
    for i in range(n_items):
        want = sorted((-s, x) for s, x in zip(score[i].tolist(), ids.tolist()) if s > 0)[:k]
        assert list(zip((-search.best[i][1]).tolist(), search.best[i][0].tolist())) == want
    assert search.scored < 0.7 * (score > 0).sum()


def test_document_value_beyond_64_bits():
    big = S.document_value(np.array([3]), np.array([10 ** 8]), 10 ** 12, 10 ** 14)
    assert big[0] == 3 * 10 ** 9 // (3000 + 12 * (75 + 25 * 10 ** 8 * 10 ** 12 // 10 ** 14))


# ------------------------------------------------------------------- toxicity
def toxic_tables():
    rng = random.Random(2)
    plain = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    bad = ["zarg", "quok", "vuxxo", "Böff"]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(3, 60))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ed"]))
        docs.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    docs += [(700, None), (701, ""), (702, "1234 !!"), (None, docs[0][1]), docs[6], docs[6], (703, "x" * 200_000), (704, "漢" * 5000)]
    labels += [(9999, 1, 1), (None, 0, 1), (3, 0, None), (5, 1, 0), (5, 1, 0)]
    return docs, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_edges(spark):
    docs, labels = toxic_tables()
    got = X.toxicity(frame(spark, docs), label_frame(spark, labels))
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in tested) / len(tested) > .97
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.score)
    assert len(by[6]) == 1 and by[700] == by[701] == by[702] and max(by[700]) < .5


def test_toxicity_learns_no_held_out_labels(spark):
    docs, labels = toxic_tables()
    turned = [(i, q, t if i is None or t is None or zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    one, two = ({(r.doc_id, round(r.score, 9)) for r in X.toxicity(frame(spark, docs), label_frame(spark, x)).collect()} for x in (labels, turned))
    assert one == two


def test_toxicity_without_labels_and_rows(spark):
    docs, labels = toxic_tables()
    alone = X.toxicity(frame(spark, docs[:20]), label_frame(spark, [x for x in labels if x[2] == 0]))
    assert len({r.score for r in alone.collect()}) == 1 and alone.first().score < .5
    assert X.toxicity(frame(spark, docs[:20]), label_frame(spark, [])).first().score == .5
    assert X.toxicity(frame(spark, []), label_frame(spark, labels)).count() == 0


def brute_kneser_ney(docs, sample, word, order, discount):
    """P_toxic and P_ordinary of a word, from dictionaries of strings."""
    token = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    grams = lambda w, k: ["^" + w + "$"] and [("^" + w + "$")[max(0, j - k + 1):j + 1] for j in range(1, len(w) + 2)]
    kinds = {w for _, t in docs for w in token.findall((t or "").lower())}
    raw = {k: Counter(g for w in kinds for g in grams(w, k) if len(g) == k) for k in range(1, order)}
    count = {}
    for k in range(1, order):
        left = Counter(g[1:] for g in raw.get(k + 1, ()))
        count[k] = {g: n if k == order - 1 or g[0] == "^" else left[g] for g, n in raw[k].items()}

    def shared(g):
        if not g:
            return 1 / len(count[1])
        ctx = [n for x, n in count[len(g)].items() if x[:-1] == g[:-1]]
        if not ctx:
            return shared(g[1:])
        return max(count[len(g)].get(g, 0) - .75, 0) / sum(ctx) + sum(min(n, .75) for n in ctx) / sum(ctx) * shared(g[1:])

    logs = []
    for kind in (1, 0):
        held = Counter(g for i, t in docs if sample.get(i) == kind for w in set(token.findall((t or "").lower())) for g in grams(w, order))
        total = 0.0
        for g in grams(word, order):
            ctx = [n for x, n in held.items() if x[:-1] == g[:-1]]
            low = shared(g[-(order - 1):])
            p = max(held.get(g, 0) - discount, 0) / sum(ctx) + sum(min(n, discount) for n in ctx) / sum(ctx) * low if ctx else low
            total += math.log(p)
        logs.append(total)
    return logs[0] - logs[1]


def test_kneser_ney_against_dictionaries(spark):
    docs, labels = toxic_tables()
    docs = [d for d in docs[:200]]
    sample = {i: t for i, _, t in labels if i is not None and i < 200 and t is not None}
    scratch = X.Scratch()
    model = X.fit_counts(frame(spark, docs).select("doc_id", "text"), spark.createDataFrame(list(sample.items()), "doc_id long, toxic int"),
                         4, 1.5, 0.003, 400_000, scratch)
    scratch.clear()
    words = ["zarg", "quoks", "böff", "unseen", "on", "a", docs[1][1].split()[0]]
    got = model.word_ratio(pa.array(words, pa.large_string()))
    for w, x in zip(words, got):
        want = brute_kneser_ney(docs, sample, w, 4, 1.5)
        assert x == pytest.approx(math.log1p(.003 * math.expm1(min(want, X.MOST))), abs=1e-9)


@pytest.mark.parametrize("common", [0, 40, 200_000])
def test_toxicity_of_large_tables_is_whole(spark, monkeypatch, common):
    """Tables of more grams than are broadcast give the scores of whole ones."""
    docs, labels = toxic_tables()
    scores = lambda **kw: sorted((r.doc_id or -1, r.held_out, r.predicted, r.score, r.log_ratio)
                                 for r in X.toxicity(frame(spark, docs), label_frame(spark, labels), **kw).collect())
    whole = scores()
    monkeypatch.setattr(X, "HELD_WORDS", common)
    cut = scores(max_ngrams=30)
    assert [r[:3] for r in cut] == [r[:3] for r in whole] and len(cut) == len(docs)
    for a, b in zip(cut, whole):
        assert a[3:] == pytest.approx(b[3:], abs=1e-6)


def test_ratios_of_large_tables_against_dictionaries(spark):
    docs, labels = toxic_tables()
    docs = docs[:200]
    sample = {i: t for i, _, t in labels if i is not None and i < 200 and t is not None}
    scratch = X.Scratch()
    fitted = X.fit_counts(frame(spark, docs).select("doc_id", "text"), spark.createDataFrame(list(sample.items()), "doc_id long, toxic int"),
                          4, 1.5, 0.003, 10, scratch)
    got = {r.word: r.ratio for r in fitted.table.collect()}
    scratch.clear()
    assert set(got) == {w for _, t in docs for w in t.lower().split()}
    for w in ["zarg", *sorted(got)[::12]]:
        want = brute_kneser_ney(docs, sample, w, 4, 1.5)
        assert got[w] == pytest.approx(math.log1p(.003 * math.expm1(min(want, X.MOST))), abs=1e-9)


# ------------------------------------------------------------------- passages
def test_shared_passages(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    plain = [(i, " ".join(words(rng.randint(0, 200)))) for i in range(60)]
    shared = {}
    docs = list(plain)
    for n, size in enumerate((43, 51, 52, 60, 90, 200)):
        passage = words(size)
        for copy in range(2):
            i = 100 + 10 * n + copy
            docs.append((i, " ".join(words(rng.randint(0, 40)) + [w.upper() if copy and w.isascii() else w for w in passage] + words(rng.randint(0, 40)))))
            shared[i] = size
    whole = " ".join(words(51))
    docs += [(300, whole), (301, whole + "\n"), (302, " ".join(words(50))), (303, None), (304, ""), (None, whole), (None, None)]
    long = " ".join(words(30_000))
    docs += [(305, long), (306, long[:150_000] + " end"), (307, "ha " * 400), (308, "ha " * 30 + "x"), (309, "ha " * 60)]
    docs += [(310, plain[5][1] + " " + " ".join(words(60))), (310, " ".join(words(60)))]          # one document
    got = {r.doc_id: r.n_passage_anchors for r in shared_passages(frame(spark, docs), 51).collect()}
    text = defaultdict(list)
    for i, t in docs:
        if i is not None:
            text[i].append(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)))
    holders = lambda k: {w: ids for w, ids in _windows(text, k).items() if len(ids) > 1}
    must, may = ({i for ids in holders(k).values() for i in ids} for k in (51, 44))
    assert must <= set(got) <= may and min(got.values()) > 0
    assert {i for i, size in shared.items() if size >= 51} <= must and {300, 301, 305, 306, 307, 309} <= must
    assert not {i for i, size in shared.items() if size < 44} & set(got)
    assert shared_passages(frame(spark, []), 51).count() == 0


def _windows(text, k):
    found = defaultdict(set)
    for i, rows in text.items():
        for w in rows:
            for a in range(len(w) - k + 1):
                found[" ".join(w[a:a + k])].add(i)
    return found
