"""Site posteriors of the quality classifier by hand sums, and the fields of
metadata records against an HTML parser and the source records."""

import math
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from ratewise.llm import queries as Q
from ratewise.llm import warc as W
from ratewise.llm.common import read_table
from ratewise.llm.quality import quality_classifier

SMALL = "/root/testdata/sf0.001"


def strength(groups):
    """Prior strength of ``(n, sum, prior)`` groups, by the method of moments."""
    g, n = len(groups), sum(x[0] for x in groups)
    spread = sum(k * (s / k - p) ** 2 for k, s, p in groups) / n
    within = sum(k * p * (1 - p) for k, s, p in groups) / n
    between = max(0.0, spread - within * g / n)
    return min(1e6, max(1.0, within / between)) if between > 0 else 1e6


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


@pytest.mark.parametrize("copies", [1, 3])
def test_posteriors_by_hand_sums(spark, copies):
    docs = read_table(spark, SMALL, "documents")
    for _ in range(copies - 1):                # repeated rows count in their sites
        docs = docs.unionByName(read_table(spark, SMALL, "documents").limit(40))
    rows = quality_classifier(docs, read_table(spark, SMALL, "labels"), weight=0.7).collect()
    assert len(rows) == docs.count()
    mean = sum(r.p_document for r in rows) / len(rows)
    host, path = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for r in rows:
        for table, k in ((host, r.host), (path, (r.host, r.path))):
            table[k][0] += 1
            table[k][1] += r.p_document
    a = strength([(n, s, mean) for n, s in host.values()])
    of_host = {h: (a * mean + s) / (a + n) for h, (n, s) in host.items()}
    b = strength([(n, s, of_host[h]) for (h, _), (n, s) in path.items()])
    assert len(host) > 3 and a < 1e6
    for r in rows:
        n, s = host[r.host]
        m, t = path[r.host, r.path]
        assert r.host_posterior == pytest.approx(of_host[r.host], abs=1e-9)
        assert r.path_posterior == pytest.approx((b * of_host[r.host] + t) / (b + m), abs=1e-9)
        rest = (a * mean + s - r.p_document) / (a + n - 1)                  # without the document itself
        rest = (b * rest + t - r.p_document) / (b + m - 1)
        p = 1 / (1 + math.exp(-(logit(r.p_document) + 0.7 * (logit(rest) - logit(mean)))))
        assert r.p_quality == pytest.approx(p, abs=1e-9) and r.kept == (r.p_quality >= 0.5 and r.p_toxic < 0.5)


class Fields(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.lang, self.inside = "", [], "", False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "a" and "href" in named:
            self.links.append(named["href"])
        if tag == "html":
            self.lang = named.get("lang", "")
        self.inside = tag == "title"

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title += data


def test_metadata_fields_of_all_pages(spark):
    sources = {r.page_id: r for r in W.responses(read_table(spark, SMALL, "pages")).collect()}
    pages = {r.page_id: r.html or "" for r in read_table(spark, SMALL, "pages").collect()}
    got = [r for r in Q.op8_warc_derivatives(spark, SMALL).collect() if r.warc_type == "metadata"]
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        fields = defaultdict(list)
        for line in r.block.split("\r\n")[:-1]:
            name, _, value = line.partition(": ")
            fields[name].append(value)
        source, p = sources[r.page_id], Fields()
        p.feed(pages[r.page_id])
        head, _, payload = source.block.partition(b"\r\n\r\n")
        assert r.refers_to == source.record_id and r.warc_date == source.warc_date and r.content_type == "application/warc-fields"
        assert fields["source-block-digest"] == [W.digest(source.block)] and fields["source-payload-length"] == [str(len(payload))]
        assert r.payload_digest == W.digest(payload) and fields["http-status"] == ["200"]
        headers = [tuple(x.split(": ", 1)) for x in head.decode().split("\r\n")[1:]]
        assert [(h["name"], h["value"]) for h in r.source_headers] == headers
        assert all(fields[f"source-header-{n.lower()}"] == [v] for n, v in headers)
        assert fields["title"] == [" ".join(p.title.split())] and fields["language"] == [p.lang] and fields["outlink"] == p.links


def test_long_and_clashing_pages(spark):
    body = "<html lang=xx><title>t</title><p>" + "word &amp; " * 200_000 + "<a href=/x>"
    rows = [(1, "http://a/", body, "carried", "block", 7), (2, None, None, None, None, None), (None, "http://b/", "<p>b", "c", "d", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, carried string, block string, http_status int")
    got = W.derive(W.responses(pages), key="page_id").collect()
    assert len(got) == 6 and sorted({str(r.page_id) for r in got}) == ["1", "2", "None"]
    text = next(r for r in got if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block.count("word &") == 200_000 and text.content_length == len(text.block.encode())
