"""Each operator against its brute-force version on one awkward fixture: null
ids and texts, empty and very long texts, repeated rows, ties, extra columns
whose names clash with the operators' own; and on an empty table."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import brute
from ratewise.llm import license_scan as L
from ratewise.llm.common import components, forest_roots
from ratewise.llm.decontaminate import decontaminate
from ratewise.llm.exact_dedup import exact_dedup
from ratewise.llm.jaccard_join import jaccard_components
from ratewise.llm.line_dedup import drop_lines, line_dedup
from ratewise.llm.packing import pack
from ratewise.llm.suffix_dedup import merge_spans, substring_dedup

EXTRA = ["key", "token", "n", "hash", "dropped_keys", "core", "digest", "node", "comp", "row_id", "lost.id"]


def make_docs():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = [(i, " ".join(words(rng.randint(1, 120)))) for i in range(30)]
    base = words(150)
    for i in range(30, 60):                     # near copies, some far from the first
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((i, " ".join(w)))
    line = "This Line stands in many Documents, word for word."
    short = "short line"
    for i in range(60, 70):
        docs.append((i, "\n".join([" ".join(words(8)), f"\t {line.upper() if i % 2 else line} ", short, " ".join(words(30)), line])))
    passage = " ".join(words(120))
    for i in range(70, 76):
        docs.append((i, " ".join(words(20)) + " " + passage + " " + " ".join(words(rng.randint(0, 40)))))
    docs += [(76, "ha " * 400), (77, "x" * 3000 + " " + "ha " * 180), (78, "Ab  c\t\nd"), (79, "Ab c d"), (80, "ab c d"),
             (81, ""), (82, None), (83, "  \n "), (84, None), (85, "one two three"), (86, "ONE two  three"), (87, "K İ ſ"),
             (88, "Released under CC-BY, cc by! All rights reserved. GNU General Public License. all RIGHTS reserved"),
             (89, "x Licensed under the Apache Public License, Version 2.0"),
             (90, " ".join(words(40_000))), (91, "a b c \x1c d<|endoftext|>e"), (92, "퟿\U0001f600 " * 30)]
    docs += [docs[3], docs[40], docs[82]]       # repeated rows
    docs += [(None, docs[5][1]), (None, None)]
    rng.shuffle(docs)
    return docs


DOCS = make_docs()
LONG = [d for d in DOCS if d[0] != 90]


def frame(spark, docs):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, t, *[f"{c}{i}" for c in EXTRA]) for i, t in docs], schema).repartition(3)


def rows(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_line_dedup(docs, none):
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert rows(line_dedup(docs), *names) == Counter(brute.line_dedup(DOCS))
    assert sum(r[2] for r in brute.line_dedup(DOCS)) > 10
    assert line_dedup(none).count() == 0
    out = drop_lines(docs.withColumnRenamed("hash", "n_chars").withColumn("n_chars", docs["doc_id"] * 0))
    assert Counter((r["doc_id"], brute.sha(r["text"] or "")) for r in out.collect()) == Counter((r[0], r[3]) for r in brute.line_dedup(DOCS))
    assert out.columns[2:] == [c if c != "hash" else "n_chars" for c in EXTRA]
    assert all(r["n_chars"] in (None, len(r["text"] or "")) for r in out.collect())
    assert drop_lines(none).columns == none.columns and drop_lines(none).count() == 0


def test_exact_dedup(docs, none):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = Counter(brute.exact_dedup(DOCS))
    assert rows(exact_dedup(docs), *names) == want
    # several rounds of exchanges
    assert rows(exact_dedup(docs, rows_per_node=5, radix=2), *names) == want
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize("length", [100, 400])
def test_substring_dedup(spark, none, length):
    d = [(i, t) for i, t in LONG]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    # a repeated row repeats its own strings, and its ranges are those of its id
    assert rows(substring_dedup(frame(spark, d), length), *names) == Counter(brute.substring_dedup(d, length))
    assert substring_dedup(none, length).count() == 0


def test_substring_dedup_random(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 300))) for _ in range(12)]
    d = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(substring_dedup(frame(spark, d), 120), *names) == Counter(brute.substring_dedup(d, 120))


def unequal_repeats():
    """Ids with rows of unequal texts: copies and near copies of two texts."""
    rng = random.Random(4)
    texts = [[f"{c}{rng.randrange(1000)}" for _ in range(80)] for c in "abcd"]
    d = []
    for i in range(40):
        for t in rng.sample(texts, rng.choice([1, 1, 2])):
            w = list(t)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(80)] = f"x{rng.randrange(9)}"
            d.append((i // 2 if i < 30 else i, " ".join(w)))
    one, two = ([f"{c}{j}" for j in range(80)] for c in "pq")
    return d + [(90, " ".join(one)), (95, " ".join(one + ["s"])), (95, " ".join(two)), (97, " ".join(two + ["t"])), (98, " ".join(texts[0])),
                (98, None), (99, ""), (99, "lone words here"), (-2**63, "far away one"), (2**63 - 1, "far away two"), (2**63 - 1, "three")]


def test_substring_dedup_unequal_rows_of_one_id(spark):
    d = unequal_repeats()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(substring_dedup(frame(spark, d), 120), *names) == Counter(brute.substring_dedup(d, 120))


@pytest.mark.parametrize("part", [0, 1])
def test_jaccard_unequal_rows_of_one_id(spark, part):
    """An id with two texts links both of their groups; rows without words go with it."""
    d = unequal_repeats()[-11:] if part else unequal_repeats()
    got = rows(jaccard_components(frame(spark, d), 4, 80), "doc_id", "n_shingles", "component_id")
    want = brute.jaccard_components(d, 4, 80)
    assert got == Counter(want)
    assert {r[2] for r in want if r[0] in (90, 95, 97)} == {90}


def test_merge_spans():
    assert merge_spans(np.array([[5, 9], [0, 3], [3, 4], [6, 7], [12, 13]])).tolist() == [[0, 4], [5, 9], [12, 13]]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(spark, none, k, percent):
    got = rows(jaccard_components(frame(spark, LONG), k, percent), "doc_id", "n_shingles", "component_id")
    want = brute.jaccard_components(LONG, k, percent)
    assert got == Counter(want)
    assert max(Counter(r[2] for r in want).values()) > 3
    assert jaccard_components(none, k, percent).count() == 0


def test_jaccard_large_group(spark):
    """Random edits of one text around the threshold: links, outliers and chains."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    d = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            j = rng.randrange(len(w))
            w[j:j + 1] = rng.choice([[], [f"v{rng.randrange(30)}"], [w[j], f"v{rng.randrange(30)}"]])
        d.append((i, " ".join(w)))
    got = rows(jaccard_components(frame(spark, d), 4, 85), "doc_id", "n_shingles", "component_id")
    want = brute.jaccard_components(d, 4, 85)
    assert got == Counter(want)
    assert 3 < len({r[2] for r in want}) < 140


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {x: p for x, p in parent.items() if any(a != b and x in (a, b) for a, b in links)}
    tree = [(i, i // 2) for i in range(1, 50)] + [(101, 100)]
    got = {r["node"]: r["comp"] for r in forest_roots(spark.createDataFrame(tree, "node long, parent long"), "t").collect()}
    assert got == {**{i: 0 for i in range(50)}, 100: 100, 101: 100}


def test_decontamination(spark, docs, none):
    texts = dict(d for d in DOCS if d[0] is not None)
    long = texts[90].split()
    items = [(0, " ".join(long[500:520])), (1, " ".join(long[900:930] + ["zzz"])), (2, " ".join(long[50:60]) + " q r s t u v w x y z"),
             (3, "one two three"), (4, None), (5, ""), (6, texts[72][:200]), (7, "HA ha ha ha ha ha ha"), (8, "nowhere to be found at all"),
             (None, texts[3]), (9, "x")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    want = brute.decontaminate(DOCS, items)
    got = rows(decontaminate(docs, bench), "doc_id", "item_id", "item_shingles", "shared")
    assert got == Counter(want) and {(90, 0), (90, 1), (85, 3), (86, 3)} <= {r[:2] for r in want}
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 0


def test_packing(docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = pack(docs, pool_tokens=20_000).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    want = defaultdict(list)
    for i, x in DOCS:
        want[i].append(t.encode(x or "", add_special_tokens=False).ids + [1])
    assert set(by) == set(want)
    for i, texts in want.items():
        if len(texts) > 1:
            assert sum(r.length for r in by[i]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(texts[0])
            assert r.ids_crc32 == zlib.crc32(np.array(texts[0][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(texts[0])
    for s, pieces in _grouped(got, "sequence_id").items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= 2048 and at & (at - 1) == 0
    steps = Counter()
    for pieces in _grouped(got, "sequence_id").values():
        steps[pieces[0].step_group] += pieces[0].sequence_length
    assert max(steps.values()) <= 1 << 16
    assert pack(none).count() == 0


def _grouped(rows_, name):
    out = defaultdict(list)
    for r in rows_:
        out[r[name]].append(r)
    return out


def test_license_scan(docs, none):
    per_doc, spans = L.license_scan(docs)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows(per_doc, *names) == Counter(brute.license_base(DOCS, L.PHRASES))
    by = {r.doc_id: r for r in per_doc.collect()}
    assert by[88].labels == "cc-by,gpl,reserved" and by[88].n_base == 5 and by[88].score == 1.0
    assert by[89].labels == "apache-2.0" and 0.75 <= by[89].score < 1.0     # one word put in: two diagonals merge
    assert by[81].score == 0.0 and by[81].n_words == 0
    assert {(r.doc_id, r.label) for r in spans.collect()} >= {(88, "gpl"), (89, "apache-2.0")}
    assert L.license_scan(none)[0].count() == 0


def test_license_notices_in_repeated_grams(spark):
    """Grams of a template that recur close by neither hide a notice nor make one."""
    notice = "Released under the MIT License."
    texts = [notice + "\nMIT License" * 3, notice + "\nfoo: MIT License" * 4, "the mit license the mit license",
             "foo: MIT License\n" * 400 + notice, (notice + " MIT License, MIT License. ") * 3, "mit license " * 400,
             "Released under the new MIT License. MIT License. MIT License."]
    per_doc, spans = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    by = {r.doc_id: (r.labels, r.score) for r in per_doc.collect()}
    assert by == {0: ("mit", 1.0), 1: ("mit", 1.0), 2: ("", 0.5), 3: ("mit", 1.0), 4: ("mit", 1.0), 5: ("", 0.25), 6: ("mit", 0.75)}
    # the edited notice has 'released under', 'under the' and 'mit license'
    assert rows(spans, "doc_id", "start_word", "n_span", "votes") == Counter(
        [(0, 0, 5, 4), (1, 0, 5, 4), (3, 1200, 5, 4), *[(4, 9 * i, 5, 4) for i in range(3)], (6, 0, 6, 3)])


def test_license_long_template(spark):
    """Positions beyond one mask; a notice whose middle is cut out, after one that is whole."""
    w = [f"w{i}" for i in range(200)]
    text = " ".join(w + ["x"] * 300 + w[:90] + ["y", "z"] + w[95:])
    per_doc, spans = L.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), [("long", " ".join(w))])
    assert per_doc.first().labels == "long" and per_doc.first().score == 1.0
    assert rows(spans, "start_word", "n_span", "votes") == Counter([(0, 200, 199), (500, 197, 193)])
