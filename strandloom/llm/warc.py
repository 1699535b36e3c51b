"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, spread
from .html import clean as clean_page
from .html import parse, render_tree, title_and_links

VERSION = "WARC/1.1"
#: Records' ids are names in this space, so that a record that is made again has the same id.
_SPACE = uuid.UUID("8d0ae5c4-4f5b-5d0f-9a37-0f8f6c1a2b7e")
#: What broken records and codings raise.
BROKEN = (OSError, EOFError, ValueError, zlib.error)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(parts))}>"


def clean(value: str) -> str:
    """A header's value on one line."""
    return (re.sub(r"[\r\n\0]+", " ", value) if "\n" in value or "\r" in value or "\0" in value else value).strip()


def make(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of headers and block; Content-Length is added."""
    lines = [VERSION, *[f"{k}: {clean(v)}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> list[tuple[str, str]]:
    """Named fields, continued lines joined."""
    out: list[tuple[str, list[str]]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n" if b"\r\n" in raw else "\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1][1].append(line.strip())
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), [v.strip()]))
    return [(k, " ".join(v)) for k, v in out]


def field(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def read(stream) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a file, plain or of gzip members."""
    if stream.read(2) == b"\x1f\x8b":
        stream.seek(0)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    else:
        stream.seek(0)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        headers = parse_headers(b"".join(head))
        size = int(field(headers, "Content-Length") or 0)
        if size < 0:
            raise ValueError("a record of negative length")
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield headers, block


def response(page_id, url: str | None, body: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record of a page that was fetched."""
    payload = (body or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(http + payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return make(headers, http + payload)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response, chunks joined and gzip undone."""
    at = block.find(b"\r\n\r\n")
    head, body = (block[:at], block[at + 4 :]) if at >= 0 else (block, b"")
    status, _, rest = head.partition(b"\r\n")
    headers = parse_headers(rest)
    if (field(headers, "Transfer-Encoding") or "").lower() == "chunked":
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) > 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if size <= 0:
                break
            out.append(body[end + 2 : end + 2 + size])
            at = end + 4 + size
        body = b"".join(out)
    if (field(headers, "Content-Encoding") or "").lower() in ("gzip", "x-gzip"):
        try:
            body = gzip.decompress(body)
        except BROKEN:
            pass  # damaged: as it stands
    return status.decode("latin-1"), headers, body


def decoded(body: bytes, headers: list[tuple[str, str]]) -> tuple[str, str]:
    """The body as text, and the charset it was read by."""
    said = re.search(r"charset=[\"']?([\w-]+)", field(headers, "Content-Type") or "", re.I)
    inside = re.search(rb"<meta[^>]*charset=[\"']?([\w-]+)", body[:2048], re.I)
    for name in [said and said[1], inside and inside[1].decode(), "utf-8"]:
        try:
            if name:
                text = body.decode(name)
                text.encode()  # some codings make halves of characters
                return text, name.lower()
        except (LookupError, ValueError):
            continue
    return body.decode("utf-8", "replace"), "utf-8"


def derive(record: bytes) -> list[dict]:
    """A response record's metadata and conversion records, each with its columns.

    Both refer to the response by id, address and date. The metadata keeps the source's HTTP headers and
    digests, the title and the links; the conversion holds the visible text. Other types give nothing. What
    no record can be read from gives a last entry with `problem` alone.
    """
    out: list[dict] = []
    records = read(io.BytesIO(record))
    while True:
        try:
            headers, block = next(records)
        except StopIteration:
            break
        except BROKEN as e:
            out.append({"problem": f"{type(e).__name__}: {e}"})
            break
        if field(headers, "WARC-Type") != "response":
            continue
        status, http, body = http_parts(block)
        text, charset = decoded(body, http)
        source, uri, date = (field(headers, n) or "" for n in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
        payload = field(headers, "WARC-Payload-Digest") or digest(body)
        tree = parse(clean_page(text))
        title, links = title_and_links(tree)
        about = [("http-status", status), *[(f"http-header-{k.lower()}", v) for k, v in http]]
        about += [("source-record-id", source), ("source-payload-digest", payload), ("source-block-digest", field(headers, "WARC-Block-Digest") or digest(block)), ("charset-detected", charset), ("title", title), ("outlinks", str(len(links)))]
        about += [("outlink", x) for x in links]
        fields = "".join(f"{k}: {clean(v)}\r\n" for k, v in about).encode()
        plain = render_tree(tree).encode()
        for kind, content, made in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", plain)):
            own = record_id(kind, source)
            other = record_id("conversion" if kind == "metadata" else "metadata", source)
            head = [
                ("WARC-Type", kind),
                ("WARC-Record-ID", own),
                ("WARC-Date", date),
                ("WARC-Target-URI", uri),
                ("WARC-Refers-To", source),
                ("WARC-Refers-To-Target-URI", uri),
                ("WARC-Refers-To-Date", date),
                ("WARC-Concurrent-To", other),
                ("WARC-Source-Payload-Digest", payload),
                ("WARC-Block-Digest", digest(made)),
                ("Content-Type", content),
            ]
            out.append({
                "record_type": kind, "record_id": own, "refers_to": source, "target_uri": uri, "date": date,
                "source_payload_digest": payload, "block_digest": digest(made), "content_type": content,
                "content_length": len(made), "record": make(head, made),
            })
    return out


_COLUMNS = ["record_type", "record_id", "refers_to", "target_uri", "date", "source_payload_digest", "block_digest", "content_type"]
SCHEMA = "page_id long, " + ", ".join(f"{c} string" for c in _COLUMNS) + ", content_length long, problem string, record binary"


def _responses(batches):
    for batch in batches:
        rows = [response(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")], strict=True)]
        for a in range(0, len(rows), 500):
            yield pa.record_batch([batch.column("page_id").slice(a, 500), pa.array(rows[a : a + 500], pa.binary())], names=["page_id", "record"])


def _derive(with_record: bool):
    def run(batches):
        for batch in batches:
            ids, records = batch.column("page_id").to_pylist(), batch.column("record").to_pylist()
            for a in range(0, len(ids), 500):
                rows = [(i, d) for i, r in zip(ids[a : a + 500], records[a : a + 500], strict=True) if r is not None for d in derive(r)]
                cols = [pa.array([i for i, _ in rows], pa.int64()), *[pa.array([d.get(c) for _, d in rows], pa.string()) for c in _COLUMNS]]
                cols += [pa.array([d.get("content_length") for _, d in rows], pa.int64()), pa.array([d.get("problem") for _, d in rows], pa.string())]
                cols += [pa.array([d.get("record") for _, d in rows], pa.binary())] * with_record
                yield pa.record_batch(cols, names=["page_id", *_COLUMNS, "content_length", "problem"] + ["record"] * with_record)

    return run


def responses(pages: DataFrame) -> DataFrame:
    """page_id and record, a response record of each page (page_id, url, html).

    Null html is an empty body, null url an empty address, a null id stays null. Equal rows give equal records. Other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    return spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).mapInArrow(_responses, "page_id long, record binary")


def derivatives(records: DataFrame, with_record: bool = True) -> DataFrame:
    """Two rows for each response record: metadata and conversion, as columns and (with_record) as a record's bytes.

    records has page_id and record (one or more WARC records; those of other types give no rows). Null
    records give no rows. What is broken gives the rows of the records before the damage and a row with
    problem, else null, and nothing more; damaged codings of a body leave it as it stands, and a charset that is unknown
    or wrong is passed over. Equal responses give equal records of equal ids. Other columns are ignored. An empty
    table gives an empty result.
    """
    schema = SCHEMA if with_record else SCHEMA.removesuffix(", record binary")
    return records.select("page_id", "record").mapInArrow(_derive(with_record), schema)


def _write(folder: str):
    def run(batches):
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(folder)
        place.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        n = size = 0
        with place.open_output_stream(f"{base}/{name}", compression=None) as sink:
            for batch in batches:
                for r in batch.column("record").to_pylist():
                    if r is None:
                        continue
                    member = gzip.compress(r, 6, mtime=0)
                    sink.write(member)
                    n, size = n + 1, size + len(member)
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return run


def write_warc(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes records to .warc.gz files of a shared folder, a gzip member each; file, records and bytes of each.

    The result lists the files that count; it has to be computed once (written or collected), as each
    computing writes files of new names. Null records are passed over; repeated ones are written each time. Other
    columns are ignored. An empty table writes files without records.
    """
    folder = folder or f"{shared_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"
    return records.select("record").mapInArrow(_write(folder), "file string, records long, bytes long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, n, record_type, record_id, record, problem for each record of WARC files; a file is read by one task.

    Repeated records are rows each. A file that is damaged gives the records before the damage and a row with problem,
    else null. An empty file gives no rows.
    """
    names = ["file", "n", "record_type", "record_id", "record", "problem"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def rows(content: bytes):
        n, records = 0, read(io.BytesIO(content))
        while True:
            try:
                headers, block = next(records)
            except StopIteration:
                return
            except BROKEN as e:
                yield n, None, None, None, f"{type(e).__name__}: {e}"
                return
            record = make([(k, v) for k, v in headers if k.lower() != "content-length"], block)
            yield n, field(headers, "WARC-Type"), field(headers, "WARC-Record-ID"), record, None
            n += 1

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for r in rows(content):
                    yield pa.record_batch([pa.array([x], t) for x, t in zip((name, *r), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, n long, record_type string, record_id string, record binary, problem string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response, as columns and as the records' bytes."""
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


QUERIES = {"op10_warc": op10_warc}
SQL: dict[str, str] = {}
