"""ARC archives of both versions, their conversion and the WARC archives' round trip."""

import gzip
import hashlib
import os

from talespark.llm import warc
from talespark.llm.warc import archive_pages, convert_archives, read_archives, read_arc, read_warc


def test_pages_against_all_payloads(spark):
    large, other = "é<p>\r\n\r\nWARC/1.1\r\nfiledesc://x 0 0 0 5\n" * 60, "<b>" * 500
    htmls = [None, "", "short", "short", large, large, large, other, "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, "y" * 3_000_000, other + "\0", "HTTP/1.1 404\n\nnot a head"]
    urls = [None, "", "http://a.b/c d\ne f", "http://ü.de/ß", "dns:a.b", "filedesc://fake.arc 1 2 3 4", "no scheme"]
    rows = [(k, urls[k % len(urls)], h, 1, "x") for k, h in enumerate(htmls * 3)] + [(None, "http://a", large, 1, "x"), (None, "http://a", "alone" * 400, 1, "x"), (70, "u", other, 1, "x"), (70, "u", other, 1, "x")]
    got = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, offset int, id string").repartition(3))
    last = {}
    for one, _, html, *_ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if one is None else one)
    want, first = [], set()
    for one, _, html, *_ in rows:
        data = (html or "").encode()
        top = last[html or ""]
        is_response = len(data) < 1000 or ((one == top or top < 0) and not (html in first or first.add(html)))
        want.append((one, len(data), hashlib.sha1(data).hexdigest(), "response" if is_response else "revisit", None if is_response else top))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def heading(version, name="a.arc"):
    return warc.arc_heading(version, name, "19990102030405") + b"\n"


def test_versions_of_headers():
    one = heading(1) + b"http://a/b c 1.2.3.4 19990102030405 text/html 21\nHTTP/1.0 200 OK\n\nbody\n" + b"dns:a 1.2.3.4 1999 text/dns 3\nxyz\n"
    two = heading(2, "b.arc") + b"http://a/ 1.2.3.4 19990102 text/html 200 - - 77 b.arc 5\n\n\n\n\n\n\n"
    for packed in (one + two, gzip.compress(one) + gzip.compress(two)):
        got = list(read_arc(packed))
        assert [(r.archive, r.url, r.date, r.mime) for r in got if "filedesc" not in r.url] == [
            ("filedesc://a.arc", "http://a/b c", "19990102030405", "text/html"), ("filedesc://a.arc", "dns:a", "1999", "text/dns"), ("filedesc://b.arc", "http://a/", "19990102", "text/html"),
        ]
        assert [r.block for r in got if "filedesc" not in r.url] == [b"HTTP/1.0 200 OK\n\nbody", b"xyz", b"\n\n\n\n\n"]
        assert all(one[r.offset :].startswith(r.url.encode()) for r in got[:3]) and not any(r.error for r in got)


def test_what_cannot_be_read_is_an_error():
    good = heading(1) + b"http://a 1.2.3.4 19990102030405 text/html 3\nabc\n"
    for bad, said in ((b"http://b 1.2.3.4 19990102030405 text/html 99\nabc\n", "of 99 bytes"), (b"http://b text/html x\nabc\n", "no header line")):
        got = list(read_arc(good + bad))
        assert len(got) == 3 and got[1].block == b"abc" and said in got[2].error
    assert "not readable" in list(read_arc(gzip.compress(good)[:-9]))[-1].error


def test_records_of_a_conversion(spark, tmp_path):
    os.makedirs(tmp_path / "arc")
    http = b"HTTP/1.0 200 OK\nX-Page-Id: %d\nContent-Length: 1200\n\n" + b"z" * 1200
    blocks = [("http://one/", http % 5), ("dns:two", b"two. 1 IN A 1.2.3.4"), ("http://three/", http % 4)]
    body = b"".join(b"%s 1.2.3.4 19990102030405 text/x %d\n%s\n" % (u.encode(), len(b), b) for u, b in blocks)
    (tmp_path / "arc" / "part-0").write_bytes(heading(1) + body)
    (tmp_path / "arc" / "part-1").write_bytes(heading(2, "b.arc") + b"broken\n")
    failed = convert_archives(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc").collect()
    assert [r.error for r in failed] == ["no header line: broken"]
    records = [x for f in sorted(os.listdir(tmp_path / "warc")) if f.startswith("part-") for x in read_warc((tmp_path / "warc" / f).read_bytes())]
    named = {n.get("warc-target-uri"): (n, b) for n, b in records}
    assert sorted(n["warc-type"] for n, _ in records) == ["resource", "response", "revisit", "warcinfo", "warcinfo"]
    (one, _), (two, dns), (three, head) = named["http://one/"], named["dns:two"], named["http://three/"]
    assert one["warc-date"] == "1999-01-02T03:04:05Z" and one["content-type"] == "application/http; msgtype=response" and dns == blocks[1][1] and two["content-type"] == "text/x"
    assert three["warc-refers-to"] == one["warc-record-id"] and three["warc-profile"] == warc.SAME_PAYLOAD and three["warc-payload-digest"] == one["warc-payload-digest"] and head == blocks[2][1][:-1200]
    assert len({n["warc-record-id"] for n, _ in records}) == 5
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in read_archives(spark, f"file://{tmp_path}/warc").collect()) == [(4, "revisit", 1200), (5, "response", 1200)]


def test_dates():
    assert [warc.warc_date(d) for d in ("19990102030405", "199901", "1999", "", "x999", "199901020304051")] == ["1999-01-02T03:04:05Z", "1999-01-01T00:00:00Z", "1999-01-01T00:00:00Z"] + ["1970-01-01T00:00:00Z"] * 3
