"""ARC and WARC files: round trips and the query against a direct computation."""

import base64
import gzip
import hashlib

import pytest

from leakfree.llm import archives as A
from leakfree.session import scratch_path

CASES = [(1, "http://a.example/x y", "one"), (2, None, "one"), (3, "https://b.example/", None), (4, "http://c.example/", ""),
         (5, "http://d.example/", "é👍\r\n\r\nWARC/1.1\r\n\x00"), (5, "http://d.example/", "é👍\r\n\r\nWARC/1.1\r\n\x00"), (None, "http://e.example/", "one"),
         (-7, "dns", "x" * 300_000), (9, "", "HTTP/1.1 200 OK\r\n\r\n"), (None, None, None), (10, "http://f.example/", "once")]


def want(rows):
    out, last = [], {}
    for k, _, h in rows:
        last[h or ""] = max(last.get(h or "", (False, 0)), (k is not None, k or 0))
    seen = set()
    for k, _, h in rows:
        h = h or ""
        data = h.encode()
        lead = last[h] == (k is not None, k or 0) and h not in seen
        if lead:
            seen.add(h)
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if lead else "revisit",
                    None if lead else (last[h][1] if last[h][0] else None)))
    return sorted(out, key=str)


def test_edge_cases(spark):
    rows = [(k, u if u is None or ":" in u else f"http://{u}", h) for k, u, h in CASES]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as payload", "3 as digest")
    for parts in (1, 3):
        assert sorted((tuple(r) for r in A.op1_warc(df.repartition(parts)).collect()), key=str) == want(rows)
    assert A.op1_warc(df.limit(0)).collect() == []


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in A.op1_warc(pages).collect()), key=str) == want(rows)


def test_files_are_standard(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.example/", "é" * 100_000), (2, "http://b.example/", "b")], "page_id long, url string, html string")
    arcs = A.write_arc(df.coalesce(1), scratch_path(spark, "arc"))
    files = A._files(spark, arcs).collect()
    text = gzip.decompress(files[0].content)
    assert text.startswith(b"filedesc://part-000000.arc 0.0.0.0 20000101000000 text/plain 76\n") and b"\n1 0 part-000000.arc\nURL IP-address" in text
    records = A.read_warcs(spark, A.convert(spark, arcs, scratch_path(spark, "warc"))).orderBy("key").collect()
    assert [(r.type, r.time, r.payload.decode()) for r in records] == [("response", "2000-01-01T00:00:00Z", "é" * 100_000), ("response", "2000-01-01T00:00:00Z", "b")]
    assert len({r.id for r in records}) == 2 and all(r.id.startswith("<urn:uuid:") for r in records)


@pytest.mark.parametrize("version", [1, 2])
def test_versions_types_and_cut_files(version):
    head = A.arc_head("n.arc", version, "1996")
    records = [A.arc_record("n.arc", version, u, d, b) for u, d, b in (("http://x/", "199701", b"abc\n"), ("dns:x", "19970102030405", b"1.2.3.4"), ("http://y/", "1997", b"cut off"))]
    text = head + b"".join(b"\n" + r for r in records)
    got = list(A.read_arc(gzip.compress(text[:40]) + gzip.compress(text[40:-3])))
    assert [r.block for r in got] == [b"abc\n", b"1.2.3.4", b"cut "] and got[2].declared == 7
    assert [A.record_kind(r.fields["URL"]) for r in got] == ["response", "resource", "response"]
    assert [A.iso_time(r.fields["Archive-date"]) for r in got] == ["1997-01-01T00:00:00Z", "1997-01-02T03:04:05Z", "1997-01-01T00:00:00Z"]
    assert all(text[r.offset:].startswith(r.fields["URL"].encode()) for r in got)
    with pytest.raises(ValueError):
        list(A.read_arc(gzip.compress(text + b"\nbad line\n")))
    with pytest.raises(ValueError):
        list(A.read_arc(gzip.compress(b"http://x/ 1 2 3 4\n")))
    assert list(A.read_arc(gzip.compress(b""))) == []


def test_member_always_ends_in_the_cut_zero():
    big = bytes(17 << 20)
    for data in (b"", b"x", big):
        assert gzip.decompress(A.member(data, 1) + b"\x00") == data
