"""Legacy archive converter: ARC records in, WARC records out.

An ARC record is one header line and a body of the length that the line declares. Which fields the line has depends
on the version that the file's own first record states: version 1 has five, version 2 ten; the media type may hold
spaces, all other fields are single words. The body of an HTTP record is the response as it came: status line, headers,
empty line, payload. The converter reads the line by its version, takes the declared number of bytes, and synthesises
what WARC asks for and ARC lacks: a record identifier from the record's file, place and content, an ISO timestamp from
the digits, the type, and SHA-256 digests of block and payload.

Types: the first record of a file becomes `warcinfo`; an HTTP record whose body begins with a status line `response`,
its block the body as it is; all others `resource`, with the media type that ARC states (`text/dns` for dns). A response
whose payload is that of an earlier one becomes a revisit: its HTTP headers, and the URI and time of the other one.

Defined cases: a null page counts as empty; white space in a URL, and a null URL, is percent-encoded resp. `-`;
rows with equal payloads and the smallest page_id are responses, all of them if repeated, with identifiers of their own;
a null page_id is never the smallest of others; an empty table gives no rows; extra columns are not read; an ARC date
of less than 14 digits begins its year, month or day; a body shorter than declared, and a header line with too few
fields, is an error.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_dealt, map_arrow, materialise, or_empty

# The fields of ARC header lines, and their titles in a file's first record.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"),
}
_TITLES = {
    "url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "status": "Result-code", "checksum": "Checksum",
    "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length",
}
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
#: Records, and bytes of their bodies, from which an archive is full.
ROWS_PER_ARCHIVE, BYTES_PER_ARCHIVE = 200, 32 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    """One record: the header line's fields, the body, and the file and place where the record begins."""

    fields: dict[str, str]
    body: bytes
    file: str = "-"
    at: int = 0


def write_arc(records: list[tuple[str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of (url, 14-digit date, media type, body), with the record that states its version first."""
    first = f"{version} 0 tidemark\n{' '.join(_TITLES[f] for f in ARC_FIELDS[version])}\n".encode()
    out, at = [], 0
    for url, date, mime, body in [(f"filedesc://{name}", "19700101000000", "text/plain", first), *records]:
        values = {"url": url, "ip": "0.0.0.0", "date": date, "mime": mime, "status": "200", "checksum": "-", "location": "-", "offset": str(at), "file": name}
        line = " ".join((values | {"length": str(len(body))})[f] for f in ARC_FIELDS[version])
        out.append(line.encode() + b"\n" + body + b"\n")
        at += len(out[-1])
    return b"".join(out)


def header_fields(line: str, version: int) -> dict[str, str]:
    """The fields of a header line; what is between the third and those after the media type is the media type."""
    names, values = ARC_FIELDS[version], line.split(" ")
    after = len(names) - names.index("mime") - 1
    if len(values) < len(names):
        raise ValueError(f"an ARC {version} header has {len(names)} fields, not {len(values)}")
    return dict(zip(names, [*values[:3], " ".join(values[3 : len(values) - after]), *values[len(values) - after :]], strict=True))


def read_arc(data: bytes, name: str = "-") -> Iterator[ArcRecord]:
    """The records of an ARC file; the body of the first states the version that the others are read by."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        length = int(line.rpartition(" ")[2])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"an ARC record at {at} declares {length} bytes, {len(body)} are there")
        first = not version
        if first:
            version = int(body.split(b" ", 1)[0])
        # the first record's own line is of either version
        yield ArcRecord(header_fields(line, 1 if first and line.count(" ") < 9 else version), body, name, at)
        at = end + 1 + length


def parted(body: bytes) -> tuple[bytes, bytes]:
    """An HTTP response's headers, with the empty line, and its payload."""
    ends = [(body.find(x), len(x)) for x in (b"\r\n\r\n", b"\n\n") if x in body]
    if not ends:
        return body, b""
    at, size = min(ends)
    return body[: at + size], body[at + size :]


def iso_time(date: str) -> str:
    """The WARC form of an ARC date."""
    date = date[:14] + "00000101000000"[len(date) :]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _sha(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def to_warc(record: ArcRecord, refers_to: tuple[str, str] | None = None) -> bytes:
    """The WARC record (a gzip member of its own) for an ARC record; a revisit if it `refers_to` another's URI and ARC date."""
    url, date, mime = (record.fields[f] for f in ("url", "date", "mime"))
    scheme = url.partition(":")[0].lower()
    head, payload = b"", record.body
    kind, content = "resource", "text/dns" if scheme == "dns" else mime
    if scheme == "filedesc":
        kind, content, payload = "warcinfo", "application/warc-fields", f"software: tidemark\r\nconformsTo: http://iipc.github.io/warc-specifications/\r\nisPartOf: {url[11:]}\r\n".encode()
    elif scheme in ("http", "https") and record.body.startswith(b"HTTP/"):
        kind, content = ("revisit" if refers_to else "response"), "application/http; msgtype=response"
        head, payload = parted(record.body)
    block = head if kind == "revisit" else head + payload
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record.file} {record.at} {url} {date} {_sha(record.body)}')}>",
        "WARC-Date": iso_time(date),
        "WARC-Payload-Digest": _sha(payload),
        "WARC-Block-Digest": _sha(block),
        "Content-Type": content,
    }
    if kind == "warcinfo":
        del headers["WARC-Payload-Digest"]
        headers["WARC-Filename"] = url[11:]
    else:
        headers["WARC-Target-URI"] = url
        if record.fields["ip"] != "0.0.0.0":
            headers["WARC-IP-Address"] = record.fields["ip"]
    if kind == "revisit":
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To-Target-URI": refers_to[0], "WARC-Refers-To-Date": iso_time(refers_to[1])}
    headers["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, one gzip member or many."""
    whole = gzip.decompress(data) if data else b""
    at = 0
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        lines = whole[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        at = end + 4 + int(fields["Content-Length"])
        yield fields, whole[end + 4 : at]
        at += 4


def page_uri(page_id: int | None, url: str | None) -> str:
    """The URL as an ARC header may hold it, with the page's number in its fragment."""
    return f"{quote(url or '-', safe='/:?#[]@!$&()*+,;=%~')}#page={page_id}"


def _page_of(uri: str) -> int | None:
    number = uri.rpartition("#page=")[2]
    return None if number == "None" else int(number)


_DATE = "20240101000000"


def page_record(page_id: int | None, url: str | None, payload: bytes) -> tuple[str, str, str, bytes]:
    """What an ARC file holds of a page: URL, date, media type, and the response as it would have come."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    uri = page_uri(page_id, url)
    # the pages came by HTTP, whatever their URL says
    return uri if uri.lower().startswith(("http:", "https:")) else f"http:{uri}", _DATE, "text/html; charset=utf-8", head.encode() + payload


def _in_archives(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (payload last) in lists that one archive takes: one row at least, and no more bytes than stated."""
    held, size = [], 0
    for row in rows:
        if held and (len(held) == ROWS_PER_ARCHIVE or size + len(row[-1]) > BYTES_PER_ARCHIVE):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield held


def write_archives(pages: DataFrame) -> DataFrame:
    """`archive` (binary): WARC files, converted from ARC files of the pages, which are of either version in turn."""
    keyed = pages.select("page_id", "url", or_empty("html").alias("html")).withColumn("digest", F.sha2("html", 256))
    # only payloads that two rows have can be revisits; the copies of a payload are dealt out
    numbered = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keyed.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min(numbered).alias("first"), F.count("*").alias("n"))
    first = materialise(first.filter("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "n"))
    marked = join_dealt(keyed, first, ["digest"], "n", "left")

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        task = TaskContext.get().partitionId()
        rows = ((*row[:4], row[4].encode("utf-8", "surrogatepass")) for columns in batches for row in zip(*columns, strict=True))
        for k, part in enumerate(_in_archives(rows)):
            name = f"pages-{task:06d}-{k:06d}.arc"
            legacy = read_arc(write_arc([page_record(i, url, payload) for i, url, _, _, payload in part], k % 2 + 1, name), name)
            refers = [(page_record(f, u, b"")[0], _DATE) if f is not None and i != f else None for i, _, f, u, _ in part]
            yield {"archive": [b"".join(to_warc(r, to) for r, to in zip(legacy, [None, *refers], strict=True))]}

    return map_arrow(marked, ["page_id", "url", "first_id", "first_url", "html"], work, "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The pages in WARC files (column `archive`): `page_id, payload_bytes, payload_digest, record_type, refers_to, warc_id, warc_date, uri, refers_to_uri`."""

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_id", "warc_date", "uri", "refers_to_uri")
        for (files,) in batches:
            rows = []
            for fields, block in (x for data in files for x in read_warc(data)):
                kind, to = fields["WARC-Type"], fields.get("WARC-Refers-To-Target-URI")
                if kind == "warcinfo":
                    continue
                head, payload = parted(block)
                length = next(int(x.partition(b":")[2]) for x in head.split(b"\n") if x.lower().startswith(b"content-length:"))
                digest = fields["WARC-Payload-Digest"]
                if _sha(block) != fields["WARC-Block-Digest"] or (kind == "response" and (len(payload) != length or _sha(payload) != digest)):
                    raise ValueError(f"{fields['WARC-Record-ID']}: its payload is not what its headers state")
                uri = fields["WARC-Target-URI"]
                rows.append((_page_of(uri), length, digest.removeprefix("sha256:"), kind, _page_of(to) if to else None, fields["WARC-Record-ID"], fields["WARC-Date"], uri, to))
            yield {c: [r[k] for r in rows] for k, c in enumerate(names)}

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_id string, warc_date string, uri string, refers_to_uri string"
    return map_arrow(archives, ["archive"], work, schema)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder, and read them back (see the module's docstring)."""
    return read_archives(materialise(write_archives(pages)))
