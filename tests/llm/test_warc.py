import gzip
import hashlib
from collections import Counter

import pytest

from galena.llm import warc as W
from galena.llm.scratch import Scratch

BIG = "<p>é</p>" * 40


def brute(rows):
    firsts = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100:
            firsts[raw] = min(firsts.get(raw, (True, 0)), (i is None, i or 0))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = raw in firsts and firsts[raw] != (i is None, i or 0)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", firsts[raw][1] if revisit else None))
    return Counter(out)


def test_pages(spark):
    rows = [
        (3, "http://a/x y", BIG), (1, "http://b", BIG), (2, None, BIG), (None, "http://n", BIG), (4, "u", "tiny"), (5, "u", "tiny"),
        (6, "", None), (7, "v", ""), (8, "v", "z" * 99), (9, "v", "z" * 99), (10, "w", "z" * 100), (11, "w", "z" * 100), (11, "w", "z" * 100),
        (12, "q", "HTTP/1.1\r\n\r\n" * 20), (13, "q", "\r\n\r\nfiledesc://" * 20), (14, "q", "y" * 5_000_000), (15, "q", "y" * 5_000_000), (1, "other", BIG),
    ]
    pages = spark.createDataFrame([(*r, "zz") for r in rows], "page_id long, url string, html string, digest string")
    scratch = Scratch(spark, "warc")
    scratch.keep("archives", W.page_archives(pages))
    got = W.read_pages(spark, scratch.path("archives"), scratch).drop("target_uri")
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_empty(spark):
    scratch = Scratch(spark, "warc")
    scratch.keep("archives", W.page_archives(spark.createDataFrame([], "page_id long, url string, html string")))
    assert W.read_pages(spark, scratch.path("archives"), scratch).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_converter(version):
    plain = W.ArcRecord({"URL": "dns:a", "IP-address": "1.2.3.4", "Archive-date": "19970922160000", "Content-type": "text/dns"}, b"a body\nof two lines")
    http = W.page_record(1, "http://a/", b"<html>\r\n\r\n</html>", "20010203040506")
    arc = W.write_arc([plain, http], version, "x.arc", "19970101000000")
    back = list(W.read_arc(gzip.compress(arc)))
    assert [r.body for r in back] == [plain.body, http.body] and back[1].payload == b"<html>\r\n\r\n</html>"
    (info, _), (a, ablock), (b, bblock) = W.read_warc(W.convert(arc, "x.arc", {}))
    assert info["WARC-Date"] == "1997-01-01T00:00:00Z"
    assert info["WARC-Type"] == "warcinfo" and (a["WARC-Type"], ablock) == ("resource", plain.body)
    assert a["WARC-IP-Address"] == "1.2.3.4" and a["WARC-Date"] == "1997-09-22T16:00:00Z" and "WARC-IP-Address" not in b
    assert (b["WARC-Type"], bblock) == ("response", http.body) and b["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(http.payload).hexdigest()
    assert W.convert(arc, "x.arc", {}) == W.convert(arc, "x.arc", {})


@pytest.mark.parametrize("cut", [-5, 20])
def test_broken(cut):
    arc = W.write_arc([W.page_record(1, "u", b"x" * 50, "2000")], 1, "x.arc", "2000")
    with pytest.raises(ValueError):
        list(W.read_arc(arc[:cut]))
    with pytest.raises(ValueError):
        list(W.read_arc(b"http://a 1.1.1.1 2000 text/html 3\nabc\n"))


@pytest.mark.parametrize("date,want", [("2000", "2000-01-01T00:00:00Z"), ("200011", "2000-11-01T00:00:00Z"), ("2000110203", "2000-11-02T03:00:00Z")])
def test_dates(date, want):
    assert W._iso(date) == want
    for bad in ("", "200", "20001301", "200002301", "00000000000000", "2000-01-01", "²²²²"):
        with pytest.raises(ValueError):
            W._iso(bad)


def test_reader_is_linear():
    """Members larger and smaller than what is read at a time, with an end inside a step."""
    arc = W.write_arc([W.page_record(i, f"http://a/{i}", bytes(range(256)) * (i * 40), "2000") for i in range(30)], 1, "x.arc", "2000")
    raw = W.convert(arc, "x.arc", {})
    assert [len(block) for _, block in W.read_warc(raw)][1:] == [len(r.body) for r in W.read_arc(arc)]
    with pytest.raises(ValueError):
        list(W.read_warc(raw[:-3]))
