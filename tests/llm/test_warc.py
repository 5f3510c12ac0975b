import base64
import glob
import gzip
import hashlib
import tempfile
import zlib

from quarry.llm import queries, warc
from quarry.sources.tables import table

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> -->
<h1>Head</h1><p>One &lt;two&gt; <b>three</b><br>four&nbsp;five</p><script>x</script><a href="/in?a=1&amp;b=2">in</a><a class=x href='out'>out</a></body></html>"""


def responses(spark, blocks):
    rows = [(k, f"<urn:uuid:{k}>", f"http://h/{k}", "2024-01-01T00:00:00Z", b, 1, 2) for k, b in enumerate(blocks)]
    return spark.createDataFrame(rows, "key long, record_id string, target_uri string, date string, block binary, refers_to long, kind long")


def test_plain_text_and_fields():
    rows = warc.derived(1, "<urn:uuid:s>", "http://h/", "2024", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: b\r\n c\r\n\r\n" + PAGE.encode())
    meta, text = (dict(zip(warc.FIELDS, r)) for r in rows)
    assert text["block"] == "Head\nOne <two> three\nfour five\ninout"
    assert meta["refers_to"] == text["refers_to"] == "<urn:uuid:s>" and meta["record_id"] != text["record_id"]
    lines = meta["block"].split("\r\n")
    for want in ("sourceRecord: <urn:uuid:s>", "httpStatus: HTTP/1.1 200 OK", "httpHeader: x-a: b c", "title: A & B", "outlink: /in?a=1&b=2", "outlink: out"):
        assert want in lines
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert text["source_payload_digest"] == sha(PAGE.encode()) and text["block_digest"] == sha(text["block"].encode())


def test_odd_responses(spark):
    http = lambda head, body: b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    blocks = [
        http(b"Content-Type: text/html; charset=latin-1", "<p>é".encode("latin-1")), http(b"Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(b"<p>zipped")),
        http(b"Content-Type: text/html\r\nTransfer-Encoding: chunked", b"4\r\n<p>c\r\n3\r\nhun\r\n0\r\n\r\n"), http(b"Content-Type: image/png", b"\x89PNG"),
        http(b"Content-Type: text/plain", b"a < b\n<p>"), http(b"Content-Type: text/html\r\nContent-Encoding: gzip", b"broken"), b"", None, b"<p>no head",
        http(b"Content-Type: text/html; charset=none-such", b"x"), http(b"Content-Type: text/html", b"<p>" + b"long " * 200000), http(b"", b"\xff\xfe")]
    got = {(r.key, r.warc_type): r for r in warc.derivatives(responses(spark, blocks)).collect()}
    text = {k: r.block for (k, kind), r in got.items() if kind == "conversion"}
    assert (text[0], text[1], text[2], text[4], text[5], text[6], text[7], text[8], text[9]) == ("é", "zipped", "chun", "a < b\n<p>", "broken", "", "", "no head", "x")
    assert 3 not in text and len(text[10]) == 999999 and len(got) == 2 * len(blocks) - 1
    assert warc.derivatives(responses(spark, blocks).limit(0)).count() == 0


def test_open_elements_leave_the_text():
    pages = {
        "<html><head><title>x</title><p>All of the text": "All of the text", "<head><meta charset=a><link href=b>Bare text <b>here</b>": "Bare text here",
        "<head><title>x</title></head>y": "y", "<head><title>x</title><script>'</head>'</script><body>y": "y", "<p>a<svg class=\"i\"/>b<p>c": "a b\nc",
        "<p>a<svg class='>'/>b": "a b", "<p>a<svg><path d='x'/>no</svg>b": "a b", "<p>a<noscript>b<p>c": "a b\nc", "<p>a<template id=t>b": "a b", "<p>a<svg>b": "a b",
        "<p>a<noscript>no</noscript>b<noscript>c": "a b c", "<p>a<script>no": "a", "<p>a<!-- no": "a", "<body><p>a<head>b": "ab"}
    assert {p: warc.plain_text(p) for p in pages} == pages


def test_content_codings():
    def text(coding, body):
        rows = warc.derived(1, "s", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: " + coding + b"\r\n\r\n" + body)
        return [r[-1] for r in rows if r[1] == "conversion"]

    raw = zlib.compressobj(wbits=-15)
    assert text(b"gzip", gzip.compress(b"<p>one ") + gzip.compress(b"two ") + gzip.compress(b"three")) == ["one two three"]
    assert text(b"gzip", gzip.compress(b"<p>one") + b"\0\0") == ["one"] and text(b"deflate", zlib.compress(b"<p>z")) == ["z"]
    assert text(b"deflate", raw.compress(b"<p>raw") + raw.flush()) == ["raw"] and text(b"gzip, gzip", gzip.compress(gzip.compress(b"twice"))) == ["twice"]
    assert text(b"br", b"\x0b\x02\x80<p>a\x03") == [] and text(b"gzip", gzip.compress(b"cut " * 99)[:-9])[0] != ""


def test_null_pages(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "http://x", "<p>t", 2), (1, None, None, 1)], "page_id long, url string, html string, block long")
    rows = warc.derivatives(warc.responses(df, "2024")).collect()
    assert len(rows) == 6 and {r.block for r in rows if r.warc_type == "conversion"} == {"", "t"}


def test_files_hold_the_records(spark):
    records = warc.derivatives(warc.responses(table(spark, SF, "pages"), "2024-01-01T00:00:00Z"))
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/warc"
    warc.write(records, path)
    want, found = {r.record_id: r for r in records.collect()}, 0
    for f in glob.glob(path + "/part-*"):
        with open(f, "rb") as h:
            data = h.read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            n = int(fields["Content-Length"])
            r = want[fields["WARC-Record-ID"]]
            assert rest[:n].decode() == r.block and rest[n:n + 4] == b"\r\n\r\n" and fields["WARC-Refers-To"] == r.refers_to
            assert fields["WARC-Block-Digest"] == warc.digest(rest[:n])
            data, found = rest[n + 4:], found + 1
    assert found == len(want) == 2 * table(spark, SF, "pages").count()


def test_op1_on_pages(spark):
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    rows = queries.op1_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        assert r.source_payload_digest == warc.digest(pages[r.page_id].html.encode()) and r.target_uri == pages[r.page_id].url
        assert r.warc_type == "metadata" or r.block == warc.plain_text(pages[r.page_id].html)


def test_tags_cells_and_hidden_parts():
    pages = {
        '<img alt="a > b" src=x>text': "text", '<div title="x>y">hello</div>': "hello", "<p title='1 > 0'>one<p>two": "one\ntwo", '<p class="open>shown': "shown",
        "<table><tr><td>a</td><td>b</td></tr></table>": "a b", "<select><option>A<option>B</select>": "A B", "a<iframe src=x>inside</iframe>b": "a b",
        "<b title=it's>still here</b>": "still here", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    }
    assert {p: warc.plain_text(p) for p in pages} == pages
    page = ('<head><title>Own</title></head><svg><title>not this</title></svg><!-- <a href="/comment"> --><script>x = \'<a href="/script">\'</script>'
            '<a title="x > y" href="/one">1</a><a data-href="/no">2</a><a href=/two>3</a><abbr href="/abbr">')
    row = warc.derived(1, "s", "http://h/", "d", b"HTTP/1.1 200 OK\nContent-Type: text/html\n\n" + page.encode())
    fields = row[0][11].split("\r\n")
    assert [f for f in fields if f.startswith(("title", "outlink"))] == ["title: Own", "outlink: /one", "outlink: /two"]
    assert "httpStatus: HTTP/1.1 200 OK" in fields and "httpHeader: content-type: text/html" in fields and row[1][11] == "123"


def test_charset_is_not_taken_from_prose():
    text = lambda body, kind=b"text/html": warc.derived(1, "s", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n\r\n" + body)[-1][11]
    assert text("<p>Set charset=latin-1 for é.".encode()) == "Set charset=latin-1 for é."
    assert text('<meta http-equiv=x content="text/html; charset=latin-1"><p>é'.encode("latin-1")) == "é"
    assert text("<meta charset='latin-1'>é".encode(), b"text/plain") == "<meta charset='latin-1'>é"
    assert text('<?xml version="1.0" encoding="latin-1"?><p>é</p>'.encode("latin-1"), b"application/xhtml+xml") == "é"
