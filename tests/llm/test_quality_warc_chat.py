"""Classifier accuracy on held-out rows and its site posteriors; WARC round
trip; chat reconstruction and escapes."""

import random
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from llm import brute
from ratewise.llm import chat_format as C
from ratewise.llm import queries as Q
from ratewise.llm import warc as W
from ratewise.llm.quality import quality_classifier

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    got = quality_classifier(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.95 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_quality_shrinkage_and_edges(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdef") for _ in range(40))
    bad = lambda: " ".join(rng.choice(["###", "$$$", "!!!"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "big" if i < 150 else "small", "en", i, "x") for i in range(152)]
    rows += [(200, None, None, None, None, None), (201, "", "big", None, 1, "x"), (None, good(), "big", "en", 1, "x"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_host long, words string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)] + [(5, None, None), (999, 1, 1), (None, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality_classifier(docs, labels).collect()
    assert len(got) == len(rows)
    sure = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 152}
    assert all(sure[i] == bool(i % 3) for i in sure)
    by = {r.host: r.host_posterior for r in got}
    mean = sum(r.p_document for r in got) / len(got)
    p = {h: [r.p_document for r in got if r.host == h] for h in by}
    for h, x in p.items():           # between the prior and the group's own mean
        own = sum(x) / len(x)
        assert min(own, mean) - 1e-9 <= by[h] <= max(own, mean) + 1e-9
    assert quality_classifier(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in quality_classifier(docs, labels.limit(0)).collect())


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template", "noscript")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "template", "noscript")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_warc_derivatives(spark):
    got = Q.op8_warc_derivatives(spark, SMALL).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(got) == 2 * len(pages)
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got)
    for r in got:
        other = ids[r.concurrent_to]
        assert other.concurrent_to == r.record_id and other.refers_to == r.refers_to and {r.warc_type, other.warc_type} == {"metadata", "conversion"}
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.payload_digest == W.digest(page.html.encode())
        assert r.block_digest == W.digest(r.block.encode()) and r.content_length == len(r.block.encode()) and r.http_status == 200
        if r.warc_type == "conversion":
            p = Text()
            p.feed(page.html)
            squeeze = lambda x: "".join(x.replace("\xa0", " ").split())
            assert squeeze(r.block) == squeeze("".join(p.words))


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<html lang=fr><title>T &amp; t</title><p>x<br>WARC/1.1\r\n\r\ny<a href='/z?a=1&amp;b'>z</a>"),
                                   (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    derived = W.derive(W.responses(pages))
    path = str(tmp_path / "w")
    W.warc_text(derived).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    back = W.read_warc(spark, path).collect()
    want = derived.collect()
    assert sorted((r.record_id, bytes(r.block).decode(), r.headers["warc-refers-to"], r.headers["warc-payload-digest"]) for r in back) == sorted(
        (r.record_id, r.block, r.refers_to, r.payload_digest) for r in want)
    meta = next(r for r in want if r.warc_type == "metadata" and r.target_uri == "http://a/é").block
    assert "title: T & t\r\n" in meta and "outlink: /z?a=1&b\r\n" in meta and "language: fr\r\n" in meta
    assert W.derive(W.responses(pages.limit(0))).count() == 0
    assert W.parse_response(b"plain") == (None, [], b"plain")


def test_chat_reconstruction(spark):
    e = [("a", 1, "message", 0, "user", "hi"), ("a", 2, "message", 1, "assistant", ""), ("a", 3, "delta", 1, None, "wr"), ("a", 4, "delta", 1, None, "ong"),
         ("a", 5, "regenerate", 1, None, None), ("a", 6, "delta", 1, None, "go"), ("a", 7, "delta", 1, None, "od"), ("a", 8, "edit", 0, None, "hi!"),
         ("b", 1, "delta", 0, None, "x"), (None, 1, None, None, None, None), ("c", 2, "delta", 0, "user", "2"), ("c", 1, "delta", 0, "user", "1")]
    df = spark.createDataFrame([(*x, "z") for x in e], "conv_id string, seq long, event string, turn long, role string, text string, messages string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in C.reconstruct(df).collect()}
    assert got == {"a": [(0, "user", "hi!"), (1, "assistant", "good")], "b": [(0, "", "x")], "c": [(0, "user", "12")], None: [(None, "", "")]}
    assert C.read_back(C.render(C.reconstruct(df.limit(0)))).count() == 0


def test_chat_escapes(spark):
    rng = random.Random(4)
    parts = ["<|", "|>", "\\", "<", "|", "turn", "<|turn|>", "<|end|>\n", "<|text|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\n", "é", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = [(i // 4, i % 4, ["user", "assistant", "sys\ntem<|text|>", None][rng.randrange(4)], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = C.render(C.reconstruct(C.events_of(df)))
    got = {r.conv_id: r for r in C.read_back(rendered).collect()}
    for r in rendered.collect():
        assert "".join(s.piece for s in r.segments) == r.formatted
        assert r.formatted.count("<|turn|>") == 4 and not any(c in r.formatted for c in ("</s>", "[INST]", "[/INST]"))
        mine = [x for x in rows if x[0] == r.conv_id]
        g = got[r.conv_id]
        assert g.turns_sha256 == brute.sha("".join(f"{x[2] or ''}\n{x[3]}\n" for x in mine))
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert (g.n_turns, g.loss_chars, g.loss_sha256, g.formatted_chars) == (4, len(loss), brute.sha(loss), len(r.formatted))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_registered_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    res = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    df = Q.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(key, res.fetchall()))


def test_pipeline_stages(spark):
    """Each stage against its brute-force version on its own input."""
    import corpus_pipeline as P
    from ratewise.llm.common import scratch
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    for name, stage in P.STAGES:
        before = pairs(docs)
        docs = scratch(stage(spark, docs, SMALL), "test")
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in before}
            break
        assert docs.columns == columns
        after = pairs(docs)
        if name == "quality classifier":
            judged = {r.doc_id: r.kept for r in quality_classifier(spark.createDataFrame(
                spark.read.parquet(f"{SMALL}/documents.parquet").collect()), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
            assert sorted(after) == sorted((i, t) for i, t in before if judged[i]) and 0 < len(after) < len(before)
        elif name == "line dedup":
            assert sorted((i, brute.sha(t or "")) for i, t in after) == sorted((r[0], r[3]) for r in brute.line_dedup(before))
        elif name == "n-gram Jaccard join":
            keep = {r[0] for r in brute.jaccard_components(before, 5, 80) if r[0] == r[2]}
            assert sorted(after) == sorted(x for x in before if x[0] in keep)
        else:
            gone = {r[0] for r in brute.decontaminate(before, bench)}
            assert sorted(after) == sorted(x for x in before if x[0] not in gone)
    assert P.run(spark, SMALL).count() == docs.count()
    assert docs.agg(F.count_if(F.col("length") <= 0)).first()[0] == 0


def test_evidence_takes_rare_strong_words(spark):
    """A word of five toxic rows alone is found behind any number of commoner words."""
    from ratewise.llm.quality import fit
    docs = [(i, " ".join(a + b + "ord" for a in "bcdfghkl" for b in "aeiou") + (" venom" if i < 5 else "")) for i in range(120)]
    evidence, _ = fit(spark.createDataFrame(docs, "doc_id long, text string"),
                      spark.createDataFrame([(i, int(i % 2), int(i < 5)) for i in range(120)], "doc_id long, quality int, toxic int"), max_words=1)
    assert len(evidence.words) == 1
