"""Media columns: payloads as images, content-addressed in tar shards; rows carry digest, offset and length."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, salted_join, spread

#: An image has rows of WIDTH pixels of three 8-bit samples, so a payload is a multiple of 192 bytes.
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Bytes after which a task begins its next shard, and that a header read fetches.
SHARD_BYTES, HEADER_BYTES = 64 << 20, 96
#: How hard images are compressed; of text, 6 stores a seventh less than 1 in twice the time.
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of a row."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """A lossless RGB image of the payload; n_bytes, its length without padding, stands in the header."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
    note = b"Source bytes\0" + str(n_bytes).encode()
    return _SIGNATURE + _part(b"IHDR", head) + _part(b"tEXt", note) + _part(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _part(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int, int]:
    """Width, height, bit depth, channels and source bytes from an image's first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"tEXt":
        raise ValueError("no image of this kind")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    size = struct.unpack(">I", head[33:37])[0]
    return width, height, depth, {0: 1, 2: 3}[colour], int(head[41 : 41 + size].split(b"\0")[1])


def from_png(image: bytes) -> bytes:
    """The payload of an image; every part's checksum is held against its bytes."""
    at, data = 8, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        part = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size in pixels, mean and deviation of samples, and a 64-bit hash of rises between 65 equal parts."""
    x = np.frombuffer(payload, np.uint8)
    bounds = np.arange(65) * len(x) // 65
    means = np.add.reduceat(x, bounds, dtype=np.int64) / np.diff(np.append(bounds, len(x)))
    rises = np.packbits(means[1:] > means[:-1]).tobytes().hex()
    return f"{WIDTH}x{len(x) // ROW}:{x.mean():.3f}:{x.std():.3f}:{rises}"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _member(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT if size < 8 << 30 else tarfile.GNU_FORMAT)


def _store(folder: str):
    """Rows of documents to shards; a content is stored once by a task."""

    def run(batches):
        place, base = _open(folder)
        place.create_dir(base, recursive=True)
        stem = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"  # attempts never share a file
        known: dict[bytes, tuple[str, int, int]] = {}
        sink, name, at, n = None, "", 0, 0

        def close():
            sink.write(bytes(2 * tarfile.BLOCKSIZE))
            sink.close()

        for batch in batches:
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                payload = padded(raw)
                # the length is part of the address: texts that differ in trailing spaces alone stay apart
                digest = hashlib.sha256(len(raw).to_bytes(8, "big") + payload).digest()
                if digest not in known:
                    image = to_png(payload, len(raw))
                    if sink is not None and at + len(image) > SHARD_BYTES:
                        close()
                        sink = None
                    if sink is None:
                        name, at, n = f"{stem}-{n:04d}.tar", 0, n + 1
                        sink = place.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                    head = _member(f"{digest.hex()}.png", len(image))
                    pad = -len(image) % tarfile.BLOCKSIZE
                    sink.write(head + image + bytes(pad))
                    known[digest] = name, at + len(head), len(image)
                    at += len(head) + len(image) + pad
                out.append((i, len(raw), digest, *known[digest]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if sink is not None:
            close()

    return run


def _entries(batches, folder: str):
    """Digest and an opened file's reader for each entry, shard by shard."""
    place, base = _open(folder)
    now, source = None, None
    for batch in batches:
        for digest, shard, offset, length in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")], strict=True):
            if shard != now:
                if source is not None:
                    source.close()
                source, now = place.open_input_file(f"{base}/{shard}"), shard
            yield digest, source, offset, length
    if source is not None:
        source.close()


def _batched(rows, names, types, most: int = 5000):
    out = []
    for r in rows:
        out.append(r)
        if len(out) == most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _headers(folder: str):
    def run(batches):
        rows = ((d, *png_header(f.read_at(min(HEADER_BYTES, length), offset))) for d, f, offset, length in _entries(batches, folder))
        yield from _batched(rows, ["digest", *_HEADER], [pa.binary(), *[pa.int64()] * 5])

    return run


_HEADER = ["width", "height", "bit_depth", "channels", "source_bytes"]
_CONTENT = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _content(image: bytes) -> tuple:
    payload = from_png(image)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)


def _contents(folder: str):
    def run(batches):
        rows = ((d, *_content(f.read_at(length, offset))) for d, f, offset, length in _entries(batches, folder))
        yield from _batched(rows, ["digest", *_CONTENT], [pa.binary(), *_CONTENT.values()], 500)

    return run


def _everything(folder: str):
    """Header metadata by a range read of the header, then the contents' columns, shard by shard."""

    def run(batches):
        def both():
            for d, f, offset, length in _entries(batches, folder):
                yield d, *png_header(f.read_at(min(HEADER_BYTES, length), offset)), *_content(f.read_at(length, offset))

        yield from _batched(both(), ["digest", *_HEADER, *_CONTENT], [pa.binary(), *[pa.int64()] * 5, *_CONTENT.values()], 500)

    return run


class MediaTable:
    """Documents' payloads in tar shards below a shared folder.

    rows: doc_id, n_bytes, digest, shard, offset, length. The digest is of length and payload, and equal
    contents carry one place (the least of those where tasks stored them). Shards are written by tasks
    themselves, through the file system of the shared folder's address; a task that is run again writes
    files of other names, so rows never point into a broken one (files of lost attempts stay behind).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch = Scratch(docs.sparkSession, "media")
        self.folder = self.scratch.path("shards")
        given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.stored = self.scratch.table(spread(given).mapInArrow(_store(self.folder), "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "rows")
        place = F.min(F.struct("shard", "offset", "length")).alias("p")
        self.places = self.scratch.table(self.stored.groupBy("digest").agg(place).select("digest", "p.*"), "places")

    @property
    def rows(self) -> DataFrame:
        return self._with(self.places)

    def _with(self, table: DataFrame) -> DataFrame:
        """The rows with a table's row of their digest, of which one may be that of very many rows."""
        return salted_join(self.stored.select("doc_id", "n_bytes", "digest"), table, ["digest"], ["doc_id"])

    def _by_shard(self) -> DataFrame:
        return self.places.repartition("shard").sortWithinPartitions("shard", "offset")

    def metadata(self) -> DataFrame:
        """digest, width, height, bit_depth, channels, source_bytes: from a range read of each header alone."""
        return self._by_shard().mapInArrow(_headers(self.folder), f"digest binary, {_ddl(_HEADER)}")

    def contents(self) -> DataFrame:
        """digest and what is computed from the stored bytes, read back: sizes, digests, checksum, feature."""
        return self._by_shard().mapInArrow(_contents(self.folder), f"digest binary, {_ddl(_CONTENT)}")

    def columns(self, places: bool = True) -> DataFrame:
        """Each row with its header's and contents' columns and (places) where its image lies."""
        known = self._by_shard().mapInArrow(_everything(self.folder), f"digest binary, {_ddl(_HEADER)}, {_ddl(_CONTENT)}")
        return self._with(known.join(self.places, "digest") if places else known)


def _ddl(names) -> str:
    return ", ".join(f"{c} {'string' if c in ('payload_sha256', 'media_sha256', 'feature') else 'long'}" for c in names)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's digest, place, header metadata and contents' columns.

    Null text is stored as empty: one row of spaces. Repeated rows share a place. A null id stays null.
    Other columns are ignored. An empty table gives an empty result.
    """
    return MediaTable(docs, id_col, text_col).columns()


def read_image(folder: str, shard: str, offset: int, length: int) -> bytes:
    """A stored image, by one range read."""
    place, base = _open(folder)
    with place.open_input_file(f"{base}/{shard}") as f:
        return f.read_at(length, offset)


def members(data: bytes) -> list[tuple[str, int, int]]:
    """Names, offsets and sizes in a shard, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return [(m.name, m.offset_data, m.size) for m in t]


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as stored samples, read back."""
    out = MediaTable(spark.read.parquet(f"{sf_dir}/documents.parquet")).columns(places=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


QUERIES = {"op4_media": op4_media}
SQL: dict[str, str] = {}
