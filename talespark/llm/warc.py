"""Legacy archives converted to WARC: ARC header lines and declared lengths in, WARC records with ids, dates, types and digests out."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import string
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_folder, slices

#: Field names of an ARC record's header line, by version (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The profile of a revisit record (a fixed value of the format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP header that carries a page's id through the archives.
ID_HEADER = "X-Page-Id"
#: Characters that may stand in a url of a header line.
_URL_SAFE = "".join(c for c in string.punctuation)
_PLACE = "path string, archive string, offset long"


def _opened(content: bytes) -> io.BufferedIOBase:
    """An archive's bytes, unpacked as they are read if they are gzip, of one member or of many."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _split_head(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, its blank line included, and its payload. Without a head: all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    at = sum(min(ends)) if ends else len(block)
    return block[:at], block[at:]


def _headers(head: bytes) -> dict[str, str]:
    """Named values of a head's lines, names lower-cased; the first of a name counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _whole(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() and value.isascii() else None


# --- ARC -------------------------------------------------------------------------------------------------------------


def arc_record(version: int, url: str | None, payload: bytes, page_id: int | None, date: str, at: int, name: str) -> bytes:
    """A page as an ARC record without the newline that ends it: header line, HTTP head, payload."""
    own = b"" if page_id is None else f"{ID_HEADER}: {page_id}\r\n".encode()
    head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), own)
    length = len(head) + len(payload)
    target = quote(url or "-", safe=_URL_SAFE)
    if target.startswith("filedesc:"):  # that would be a heading
        target = target.replace(":", "%3A", 1)
    fields = [target, "0.0.0.0", date, "text/html"] + ([] if version == 1 else ["200", "-", "-", str(at), name])
    return b"%s %d\n%s%s" % (" ".join(fields).encode(), length, head, payload)


def arc_heading(version: int, name: str, date: str) -> bytes:
    """The record an ARC file begins with: it names the version and the fields of the header lines to come."""
    block = f"{version} 0 talespark\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + ([] if version == 1 else ["200", "-", "-", "0", name])
    return b"%s %d\n%s" % (" ".join(fields).encode(), len(block), block)


@dataclass
class ArcRecord:
    archive: str
    offset: int
    url: str
    date: str
    mime: str
    block: bytes
    error: str | None = None


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its headings included, each cut by the length its header line declares.

    A heading sets the version: its block names the fields of the lines that follow, of which the last is the length; a
    url may hold blanks, as the other fields are counted from the end. What cannot be read (a line with too few fields or
    no length, a block shorter than declared) is one record with an error, and the file ends there, as nothing tells where
    the next one begins.
    """
    source, offset, archive, fields = _opened(content), 0, "", ARC_FIELDS[1].split(" ")
    try:
        while line := source.readline():
            at, offset = offset, offset + len(line)
            if not line.strip():
                continue
            told = line.decode("utf-8", "replace").rstrip("\r\n")
            heading = told.startswith("filedesc://")
            parts = told.split(" ") if heading else told.rsplit(" ", len(fields) - 1)
            length = _whole(parts[-1])
            if length is None or length < 0 or len(parts) < (5 if heading else len(fields)):
                yield ArcRecord(archive, at, "", "", "", b"", f"no header line: {told[:80]}")
                return
            block = source.read(length)
            offset += len(block)
            error = None if len(block) == length else f"{len(block)} of {length} bytes"
            named = dict(zip(["URL", "IP-address", "Archive-date", "Content-type"], parts))
            if heading:
                archive = parts[0]
                lines = block.decode("utf-8", "replace").split("\n")
                version = _whole(lines[0].split(" ")[0]) or 1
                fields = lines[1].split() if len(lines) > 1 and len(lines[1].split()) >= 5 else ARC_FIELDS[min(2, max(1, version))].split(" ")
            else:
                named = dict(zip(fields, parts))
            yield ArcRecord(archive, at, named.get("URL", ""), named.get("Archive-date", ""), named.get("Content-type", ""), block, error)
            if error:
                return
    except (EOFError, OSError, gzip.BadGzipFile) as e:
        yield ArcRecord(archive, offset, "", "", "", b"", f"not readable: {e}")


def write_arc(pages: DataFrame, folder: str, archive_bytes: int = 16 << 20, date: str = "20000101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """``pages`` as ARC archives in ``folder``, of about ``archive_bytes`` each, by turns of versions 1 and 2, gzipped.

    Spark's text writer writes the bytes, so its commit protocol holds: a repeated task leaves each record once.
    """
    read = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    read = read.withColumn("row", F.monotonically_increasing_id())
    size = read.agg(F.sum(F.octet_length("html") + 300)).first()[0] or 0
    dealt = read.repartition(max(1, -(-size // archive_bytes)), F.xxhash64("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = "", 0
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for one, url, html, row in zip(*(part.column(k).to_pylist() for k in range(4))):
                    if not name:
                        name, version = f"pages-{row:016x}.arc", 1 + row % 2  # named by its first row, which no other archive has
                        out.append(arc_heading(version, name, date))
                        at = len(out[0]) + 1
                    out.append(arc_record(version, url, html, one, date, at, name))
                    at += len(out[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _write(dealt.mapInArrow(run, "value binary"), folder, "\n")


def _write(records: DataFrame, folder: str, end: str) -> None:
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).option("compression", "gzip").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


# --- WARC ------------------------------------------------------------------------------------------------------------


def record_id(archive: str, offset: int) -> str:
    """The id of the record made from the one at ``offset`` of an archive: the same in every run."""
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date; what is missing is the least there is, what is no date is the year 1970."""
    digits = date if date.isascii() and date.isdigit() and 4 <= len(date) <= 14 else "1970"
    full = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_kind(url: str, block: bytes) -> str:
    """The WARC type that an ARC record stands for: a heading is warcinfo, an HTTP message response, others (dns, ftp) resource."""
    return "warcinfo" if url.startswith("filedesc://") else "response" if block.startswith(b"HTTP/") else "resource"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(arc: ArcRecord, refers: dict | None) -> bytes:
    """The WARC record of an ARC record without the last line end: of a revisit, if it refers to another."""
    kind, (head, payload) = record_kind(arc.url, arc.block), _split_head(arc.block)
    block = head if refers else arc.block
    kept = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}
    named = [("WARC-Type", "revisit" if refers else kind), ("WARC-Record-ID", record_id(arc.archive, arc.offset)), ("WARC-Date", warc_date(arc.date))]
    if kind == "warcinfo":
        block = b"software: talespark\r\nformat: WARC File Format 1.1\r\n"
        named.append(("WARC-Filename", arc.url.removeprefix("filedesc://")))
    else:
        named += [("WARC-Target-URI", arc.url)] * (arc.url not in ("", "-")) + [("WARC-Payload-Digest", _digest(payload))]
    if refers:
        named += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers["archive"], refers["offset"])), ("WARC-Refers-To-Date", warc_date(refers["date"]))]
        named += [("WARC-Refers-To-Target-URI", refers["url"])] * (refers["url"] not in ("", "-"))
    named += [("WARC-Block-Digest", _digest(block)), ("Content-Type", kept.get(kind) or arc.mime or "application/octet-stream"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in named)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n"


def convert_archives(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = 1000) -> DataFrame:
    """Writes each ARC archive of a folder as WARC in another; returns (path, offset, error) of what could not be read.

    Equal payloads of ``least_bytes`` or more are stored once: as the response with the largest id (ID_HEADER), of equal
    ids the one last in archive and offset, which the others revisit. A first pass over the archives gives digests and
    places, from which Spark finds who revisits whom; the second converts each archive, given its own revisits, so that
    payloads are not shuffled.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for arc in read_arc(content.as_py()):
                    if arc.error or record_kind(arc.url, arc.block) == "response":
                        head, payload = _split_head(arc.block)
                        rows.append((path, arc.archive, arc.offset, arc.url, arc.date, _whole(_headers(head).get(ID_HEADER.lower())), len(payload), hashlib.sha256(payload).digest(), arc.error))
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], shape)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    shape = pa.schema(list(zip(["path", "archive", "offset", "url", "date", "id", "n", "digest", "error"], kinds)))
    seen = cut(_files(spark, arc_folder).mapInArrow(look, f"{_PLACE}, url string, date string, id long, n long, digest binary, error string"))
    large = seen.filter(F.col("error").isNull() & (F.col("n") >= least_bytes))
    last = large.groupBy("digest").agg(F.max(F.struct("id", "archive", "offset", "url", "date")).alias("to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    again = large.select("path", "offset", "digest", "archive").join(cut(last), "digest").filter((F.col("offset") != F.col("to.offset")) | (F.col("archive") != F.col("to.archive")))
    own = cut(again.groupBy("path").agg(F.collect_list(F.struct("offset", "to")).alias("revisits")))  # as many as its archive, of bounded size, holds

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, revisits in zip(batch.column(0), batch.column(1).to_pylist()):
                to = {r["offset"]: r["to"] for r in revisits or []}
                out, size = [], 0
                for arc in read_arc(content.as_py()):
                    if not arc.error:
                        out.append(warc_record(arc, to.get(arc.offset)))
                        size += len(out[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    files = _files(spark, arc_folder)
    _write(files.join(own, "path", "left").select("content", "revisits").mapInArrow(convert, "value binary"), warc_folder, "\r\n")
    return seen.filter("error is not null").select("path", "offset", "error")


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named values, block) of each record of a WARC file, cut by its Content-Length."""
    source = _opened(content)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        lines = [line]
        while (line := source.readline()).strip():
            lines.append(line)
        named = _headers(b"".join(lines))
        block = source.read(int(named["content-length"]))
        if len(block) < int(named["content-length"]):
            raise ValueError(f"record {named.get('warc-record-id')} ends early")
        yield named, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record_type, target_uri, date, page_id, payload_bytes, payload_digest, refers_to_id) of a folder's WARC pages.

    Payloads are measured and hashed as they are read, and a response whose digests are not the stated ones raises. Of a
    revisit, whose payload is stored elsewhere, its own headers tell the size and the digest.
    """
    shape = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for named, block in read_warc(content.as_py()):
                    kind = named["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = _split_head(block)
                    told = _headers(head)
                    digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if _digest(block) != named["warc-block-digest"] or (kind == "response" and hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {named['warc-record-id']} is not what its digests say")
                    size = len(payload) if kind == "response" else int(told["content-length"])
                    rows.append((named["warc-record-id"], kind, named.get("warc-target-uri"), named["warc-date"], _whole(told.get(ID_HEADER.lower())), size, digest, named.get("warc-refers-to")))
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], shape)

    return _files(spark, folder).mapInArrow(run, "record_id string, record_type string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string")


def archive_pages(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from WARC archives.

    Pages go to ARC archives, these are converted (convert_archives), and the WARC archives are read; a revisit finds the
    page it refers to by the record's id. All archives lie in the shared folder and go when the result is there.

    A null html is empty; a null or odd url is written as - or with its odd bytes escaped; a null id has no header and
    stays null, and counts as the least one. Repeated rows are records of their own, so all but one revisit. Other
    columns, of any names, are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    with scratch_folder(spark) as folder:
        write_arc(pages, f"{folder}/arc", id_col=id_col, url_col=url_col, html_col=html_col)
        failed = convert_archives(spark, f"{folder}/arc", f"{folder}/warc", least_bytes)
        if bad := failed.first():
            raise ValueError(f"{bad.path} at {bad.offset}: {bad.error}")
        records = cut(read_archives(spark, f"{folder}/warc"))
    first = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(first, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
