import hashlib
import zlib

import numpy as np
import pytest
from pyarrow import fs

from strandloom.llm import media
from strandloom.llm.media import MediaTable, feature, from_png, media_columns, members, padded, png_header, read_image, to_png

from .cases import EDGES, documents, ids


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_image_round_trip(n):
    raw = bytes(i * 37 % 256 for i in range(n))
    payload = padded(raw)
    assert len(payload) % 192 == 0 and len(payload) >= max(192, n) and payload[:n] == raw and set(payload[n:]) <= {32}
    image = to_png(payload, n)
    assert from_png(image) == payload and png_header(image[: media.HEADER_BYTES]) == (64, len(payload) // 192, 8, 3, n)
    with pytest.raises(ValueError):
        from_png(image[:-20] + b"x" + image[-19:])
    with pytest.raises(ValueError):
        png_header(b"GIF89a" + image)


def test_feature():
    assert feature(bytes(192)) == "64x1:0.000:0.000:" + "0" * 16
    x = bytes(range(192))
    assert feature(x).startswith(f"64x1:{np.mean(list(x)):.3f}:") and feature(x).endswith("f" * 16)


def test_columns(spark):
    got = media_columns(documents(spark)).collect()
    assert ids([(r["doc_id"],) for r in got]) == ids(EDGES)
    texts = {r[0]: (r[1] or "").encode() for r in EDGES}
    for r in got:
        raw = texts[r["doc_id"]]
        p = padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        image = to_png(p, len(raw))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), feature(p))
        assert (r["width"], r["height"], r["source_bytes"]) == (64, len(p) // 192, len(raw))
    copies = {(r["shard"], r["offset"]) for r in got if r["doc_id"] in (1, 2, 9)}
    assert len(copies) == 1


def test_shards_are_tar_files(spark, monkeypatch):
    rows = [(i, f"text {i} " * 40, "en", "a", 1) for i in range(50)]
    table = MediaTable(documents(spark, rows).repartition(3))
    place, base = fs.FileSystem.from_uri(table.folder)
    found = {}
    for f in place.get_file_info(fs.FileSelector(base)):
        with place.open_input_file(f.path) as g:
            for name, offset, size in members(g.read()):
                found[f.base_name, offset] = (name, size)
    for r in table.rows.collect():
        name, size = found[r["shard"], r["offset"]]
        assert name == f"{r['digest'].hex()}.png" and size == r["length"]
        assert from_png(read_image(table.folder, r["shard"], r["offset"], r["length"]))[: r["n_bytes"]] == rows[r["doc_id"]][1].encode()


def test_empty(spark):
    assert media_columns(documents(spark, [])).collect() == []
