"""Texts and arrays packed into compressed values, so that few rows carry many of them."""

from __future__ import annotations

import ctypes
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

#: Bytes of text in a chunk; one longer text makes a chunk of its own.
CHUNK = 4 << 20


def lean_memory() -> None:
    """In a worker: large arrays go back to the system when they are freed, so that it holds what it uses now, not its peak."""
    try:
        ctypes.CDLL(None).mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD, which would grow by itself
    except (OSError, AttributeError):
        pass  # another C library
    pa.set_memory_pool(pa.system_memory_pool())


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one compressed value, bytes of equal weight together."""
    head = json.dumps([[a.dtype.str, a.shape] for a in arrays]).encode()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, -1).T if a.itemsize > 1 and a.size else a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for dtype, shape in json.loads(raw[4:at]):
        d, size = np.dtype(dtype), int(np.prod(shape))
        flat = np.frombuffer(raw, np.uint8, size * d.itemsize, at)
        at += size * d.itemsize
        out.append(np.ascontiguousarray(flat.reshape(d.itemsize, size).T).view(d).reshape(shape) if d.itemsize > 1 and size else flat.view(d).reshape(shape))
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def pack_bytes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(v) for v in values], np.int64), np.frombuffer(b"".join(values), np.uint8)


CHUNK_SCHEMA = "chunk long, ids array<bigint>, blob binary"


def chunks(with_lang: bool = False, most: int = CHUNK):
    """mapInArrow: rows (doc_id, text[, lang]) to chunks of about `most` bytes.

    blob packs ids, a flag for ids that are known, lengths, bytes[, lengths and bytes of languages].
    """

    def run(batches):
        lean_memory()
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, langs, size = [], [], [], 0

        def made():
            known = np.array([i is not None for i in ids], np.uint8)
            extra = pack_bytes(langs) if with_lang else ()
            blob = pack(np.array([i or 0 for i in ids], np.int64), known, *pack_bytes(texts), *extra, level=9)
            return pa.record_batch([pa.array([base + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["chunk", "ids", "blob"])

        for batch in batches:
            lang = batch.column("lang").to_pylist() if with_lang else [None] * batch.num_rows
            for i, t, g in zip(batch.column("doc_id").to_pylist(), batch.column("text"), lang, strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and size + len(raw) > most:
                    yield made()
                    ids, texts, langs, size, n = [], [], [], 0, n + 1
                ids.append(i)
                texts.append(raw)
                langs.append((g or "").encode())
                size += len(raw)
        if texts:
            yield made()

    return run
