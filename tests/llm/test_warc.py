import base64
import glob
import gzip
import hashlib
import re

import pytest

from revuelens.llm.warc import build_derivatives, derive, parse_warc, plain_text, read_warc, responses, write_warc

PAGE = (
    '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B\n c</title><style>p{}</style></head><body><script>x="</p>"</script>'
    '<!-- no --><p>One&nbsp;two<br>three</p><div><a href="/a?x=1&amp;y=2">link</a> <a href=\'b\'>l</a> 1 < 2</div>\r\n\r\nWARC/1.1\r\n</body></html>'
)


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_plain_text():
    assert plain_text(PAGE) == "One two\nthree\nlink l 1 < 2\nWARC/1.1"
    assert plain_text("") == "" and plain_text("no markup") == "no markup"


def test_records_written_and_read_back(spark, folder):
    rows = [(1, "http://x.example/1", PAGE), (2, None, None), (3, "http://x.example/3", ""), (4, "u", "é" * 100_000), (4, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as type", "2 as block")
    given = responses(pages)
    write_warc(given, folder + "/source")
    source = {r.record_id: r for r in read_warc(spark, folder + "/source").collect()}
    assert len(source) == 4 and {r.record_id: r.block for r in given.collect()} == {k: r.block for k, r in source.items()}
    found = [r for r in derive(read_warc(spark, folder + "/source")).collect()]
    assert len(found) == 10
    for r in found:
        origin = source[r.refers_to]
        assert (r.date, r.target_uri, r.source_id) == (origin.date, origin.target_uri, origin.source_id)
        assert r.block_digest == sha1(r.block)
        if r.type == "metadata":
            lines = r.block.split("\r\n")
            assert f"source-block-digest: {sha1(origin.block)}" in lines and "source-digest-valid: true" in lines
            assert f"source-payload-digest: {origin.payload_digest}" in lines
            assert "source-header: Content-Type: text/html; charset=utf-8" in lines
            twin = re.search("WARC-Concurrent-To: (.*)\r\n", r.headers)[1]
            assert {x.refers_to for x in found if x.record_id == twin} == {r.refers_to}
    page = next(r for r in found if r.source_id == "1" and r.type == "metadata")
    assert {"title: A & B c", "language: fr", "outlink: /a?x=1&y=2", "outlink: b"} <= set(page.block.split("\r\n"))
    texts = {r.source_id: r.block for r in found if r.type == "conversion"}
    assert texts == {"1": plain_text(PAGE), "2": "", "3": "", "4": "é" * 100_000}


def test_files_are_plain_warc(spark, folder):
    pages = spark.createDataFrame([(i, f"http://x/{i}", PAGE) for i in range(5)], "page_id long, url string, html string")
    write_warc(derive(responses(pages.coalesce(1))), folder + "/out")
    (name,) = glob.glob(folder + "/out/part-*.gz")
    raw = gzip.open(name).read()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert [f["type"] for f, _, _ in parse_warc(raw)] == ["conversion", "metadata"] * 5
    with pytest.raises(ValueError):
        list(parse_warc(raw[:-200]))


def test_altered_block_is_told(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>a")], "page_id long, url string, html string")
    altered = responses(pages).withColumn("block", __import__("pyspark.sql.functions", fromlist=["x"]).lit("changed"))
    blocks = {r.type: r.block for r in derive(altered).collect()}
    assert "source-digest-valid: false" in blocks["metadata"] and blocks["conversion"] == "changed"
    assert build_derivatives(spark, pages.limit(0)).count() == 0
