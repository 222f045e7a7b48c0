import base64
import glob
import hashlib
import json
import re
import time
from html.parser import HTMLParser

import pytest

from wayline.llm import queries, warc

PAGE = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{x:1}</style><script>var t="</p>";</script></head>
<body><!-- gone --><p>One <b>two</b>&nbsp;3 &lt;ok&gt;</p><a href="/x?a=1&amp;b=2">link</a><img src=pic.png><br>last &copy; <5 and <"""


def sha1(s):
    return "sha1:" + base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


def test_text_and_facts():
    assert warc.plain_text(PAGE) == "A & B\nOne two 3 <ok>\nlink\nlast © <5 and <"
    facts = warc.page_facts(PAGE, 10)
    assert (facts["title"], facts["lang"]) == ("A & B", "en")
    assert facts["links"] == [{"tag": "a", "url": "/x?a=1&b=2"}, {"tag": "img", "url": "pic.png"}]
    for odd in ("", "<", "<!-- open", "<script>x", "a < b > c", "&#0; &bogus;", "<p" * 5000):
        assert isinstance(warc.plain_text(odd), str)


def test_derived_records(spark, tmp_path):
    rows = [(1, "http://a/", PAGE, "x"), (2, None, None, "x"), (3, "http://a/", "", "x"), (4, "http://b/", "<p>" + "long é " * 50_000, "x"), (1, "http://a/", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    records = warc.derive(source, keep="page_id")
    got = records.collect()
    assert len(got) == 2 * len(rows)
    known = {r.record_id: r.page_id for r in source.collect()}
    assert len(known) == len(rows) and sorted(known.values()) == [1, 1, 2, 3, 4]
    html = {r[0]: r[2] or "" for r in rows}
    for r in got:
        assert r.refers_to == r.source_id and known[r.refers_to] == r.page_id
        assert r.source_digest == sha1(html[r.page_id]) and r.block_digest == sha1(r.block) and r.length == len(r.block.encode())
        if r.type == "metadata":
            facts = json.loads(r.block)
            assert facts["payload_digest"] == r.source_digest and facts["status"] == "HTTP/1.1 200 OK" and facts["headers"]["content-type"].startswith("text/html")
        else:
            assert r.block == warc.plain_text(html[r.page_id])
    assert len({r.record_id for r in got}) == 2 * len(rows)

    path = str(tmp_path / "out")
    warc.write_warc(records, path)
    assert glob.glob(path + "/*.gz")
    back = warc.read_warc(spark, path)
    key = lambda r: (r[0], r[1])
    want = sorted([(r.type, r.record_id, r.refers_to, r.target_uri, r.http_headers, r.block_digest, r.block) for r in got], key=key)
    cols = ["type", "record_id", "refers_to", "target_uri", "http_headers", "block_digest", "payload"]
    assert sorted(map(tuple, back.select(cols).collect()), key=key) == want


def test_reading_responses():
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hi</p>"
    data = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\nWARC/1.0\r\nContent-Length: 99\r\n\r\ncut"
    assert [(h["warc-type"], b) for h, b in warc.parse_records(data)] == [("response", body)]


def test_query(spark, sf_dir):
    got = queries.op9_warc(spark, sf_dir)
    assert got.groupBy("type").count().orderBy("type").collect() == [("conversion", 50), ("metadata", 50)]
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


class Reader(HTMLParser):
    """The text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_conversions_hold_what_a_parser_reads(spark):
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.block for r in queries.op9_warc(spark, sf).where("type = 'conversion'").collect()}
    assert set(got) == set(html)
    for page, markup in html.items():
        reader = Reader()
        reader.feed(markup or "")
        reader.close()
        assert re.sub(r"\s+", "", got[page]) == re.sub(r"\s+", "", "".join(reader.out)), page


HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)


@pytest.mark.parametrize("piece", ["<!--", "<script></", "<script", "<title>", "<style>x", "</script", "<a href='", "<p ", "-->", "<SCRIPT>x</Script ><!-- > -->y<template a>"])
def test_time_grows_with_the_length_of_a_page(piece):
    assert warc.visible(piece * 20 + "end") == HIDDEN.sub(" ", piece * 20 + "end")
    markup = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    warc.plain_text(markup)
    warc.page_facts(markup, len(markup))
    assert time.perf_counter() - began < 30  # seconds here; hours if time grew with the square
