"""Banded local alignment of many candidates at once, traced back to blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bases import reverse_complement
from .reference import begin_of, chunk_at, chunked

MATCH, MISMATCH, GAP = 1, -2, -3
#: Half a band beyond the chain's diagonals; wider bands than BAND are not aligned.
MARGIN, BAND = 1, 20
#: Cells of score matrices that are held at once.
CELLS = 4 << 20


def equal(read: np.ndarray, ref: np.ndarray, bisulfite: bool) -> np.ndarray:
    same = read == ref
    return same | ((read == ord("T")) & (ref == ord("C"))) if bisulfite else same


def score_matrices(reads: np.ndarray, sizes: np.ndarray, refs: np.ndarray, band: int, bisulfite: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores [candidate, row, place in band], with a row and a place of zeros around; and where bases agree.

    reads: padded to one length; refs: band - 1 longer. A row's gaps along it are a running maximum of
    scores that are raised by 3 a place.
    """
    n, length = reads.shape
    scores = np.zeros((n, length + 1, band + 2), np.int16)
    same = np.zeros((n, length, band), bool)
    ramp = (-GAP * np.arange(1, band + 1)).astype(np.int16)
    for i in range(length):
        hit = equal(reads[:, i : i + 1], refs[:, i : i + band], bisulfite)
        same[:, i] = hit
        last = scores[:, i]
        own = np.maximum(last[:, 1:-1] + np.where(hit, MATCH, MISMATCH).astype(np.int16), last[:, 2:] + np.int16(GAP))
        row = np.maximum.accumulate(np.maximum(own, 0) + ramp, axis=1) - ramp
        row[i >= sizes] = 0
        scores[:, i + 1, 1:-1] = row
    return scores, same


def traces(scores: np.ndarray, same: np.ndarray, rows: np.ndarray, places: np.ndarray) -> list[dict]:
    """The alignments that end in a cell of each candidate: counts, ends and blocks (v, h, size) from first to last.

    All candidates go one step at a time. At each cell a step along the diagonal comes before a gap in the read, and
    that before one in the reference; the diagonal step from a score of 0 is the first.
    """
    n = len(rows)
    row, place, stop = rows.astype(np.int64), places.astype(np.int64), rows.astype(np.int64)
    counts = np.zeros((3, n), np.int64)  # matches, mismatches, gaps
    in_block, now = np.ones(n, bool), np.arange(n)
    ended: list[tuple[np.ndarray, ...]] = []
    while len(now):
        r, p = row[now], place[now]
        if (r < 0).any():
            raise AssertionError("a local alignment starts at a score of 0")
        here, up, hit = scores[now, r + 1, p], scores[now, r, p], same[now, r, p - 1]
        diagonal = up + np.where(hit, MATCH, MISMATCH) == here
        first = diagonal & (up == 0)
        counts[0, now] += diagonal & hit
        counts[1, now] += diagonal & ~hit
        counts[2, now] += ~diagonal
        opening, closing = diagonal & ~in_block[now], ~diagonal & in_block[now]
        stop[now[opening]] = r[opening]
        for which, shift in ((closing, 1), (first, 0)):
            own = now[which]
            ended.append((own, row[own] + shift, row[own] + place[own] - 1 + shift, stop[own] - row[own] + 1 - shift))
        in_block[now] = diagonal
        side = ~diagonal & (scores[now, r + 1, p - 1] + GAP == here)
        row[now] -= (~side & ~first).astype(np.int64)
        place[now] += np.where(diagonal, 0, np.where(side, -1, 1))
        now = now[~first]
    owner, v, h, size = [np.concatenate(x)[::-1] for x in zip(*ended, strict=True)] if ended else [np.zeros(0, np.int64)] * 4
    order = np.argsort(owner, kind="stable")  # blocks were met from last to first
    bounds = np.searchsorted(owner[order], np.arange(n + 1))
    blocks = np.stack((v, h, size), axis=1)[order].tolist()
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own = [tuple(x) for x in blocks[a:b]]
        out.append({"n_match": int(counts[0, i]), "n_mismatch": int(counts[1, i]), "n_gap": int(counts[2, i]), "v_start": own[0][0], "h_start": own[0][1], "v_stop": int(rows[i]), "h_stop": int(rows[i] + places[i] - 1), "blocks": own})
    return out


def aligned(reads: list[bytes], refs: list[bytes], band: int, bisulfite: bool) -> list[tuple[int, dict | None]]:
    """Best score and alignment of each read against its stretch, which begins at the band's first diagonal."""
    out: list[tuple[int, dict | None]] = []
    length = max(map(len, reads), default=0)
    step = max(1, CELLS // max(1, (length + 1) * (band + 2)))
    for a in range(0, len(reads), step):
        part = reads[a : a + step]
        sizes = np.array([len(r) for r in part])
        long = int(sizes.max(initial=0))
        q = np.frombuffer(b"".join(r.ljust(long, b"\0") for r in part), np.uint8).reshape(len(part), long)
        t = np.frombuffer(b"".join(r[: long + band - 1].ljust(long + band - 1, b"@") for r in refs[a : a + step]), np.uint8).reshape(len(part), long + band - 1)
        scores, same = score_matrices(q, sizes, t, band, bisulfite)
        inner = scores[:, 1:, 1:-1].reshape(len(part), -1)
        best = inner.argmax(1) if inner.shape[1] else np.zeros(len(part), np.int64)
        top = inner[np.arange(len(part)), best] if inner.shape[1] else np.zeros(len(part), np.int64)
        some = np.flatnonzero(top > 0)
        found = dict(zip(some.tolist(), traces(scores[some], same[some], best[some] // band, best[some] % band + 1), strict=True))
        for i, size in enumerate(sizes.tolist()):
            good = i in found and (bisulfite or identical_enough(found[i], size))
            out.append((int(top[i]) if good else 0, found.get(i)))
    return out


def identical_enough(found: dict, size: int, least: float = 0.9) -> bool:
    """Nine in ten bases of the read match, and errors are a tenth of these at most; in single precision."""
    share = np.float32(least)
    if np.float32(found["n_match"]) < np.float32(size) * share:
        return False
    return not np.float32(found["n_mismatch"] + found["n_gap"]) > (np.float32(1) - share) * np.float32(found["n_match"])


def placed(chains: DataFrame, d: int) -> DataFrame:
    """Chains with their band: its width and the reference place of its first diagonal (a_start)."""
    first, last = F.col("h_start") - F.col("v_start"), F.col("h_stop") - F.col("v_stop")
    shift = F.abs(first - last)
    band = F.when(shift == 0, 2 * MARGIN + 1).otherwise(shift + 4 * MARGIN + 1)
    return chains.withColumn("band", band.cast("int")).withColumn("a_start", F.when(F.col("run") >= 0, F.col("window") * d + F.least(first, last) - MARGIN))


def with_templates(chains: DataFrame, refs: DataFrame, reads: DataFrame, everything: bool = False) -> DataFrame:
    """Candidates with the read as it was matched (revcomp for strand 1) and the reference below its band, @ beyond its ends.

    refs: contigs or their chunks, of which a candidate is joined with one. everything: chains that are not aligned,
    for want of a second pair or for too wide a band, stay with nulls.
    """
    begin, good = F.greatest(F.col("a_start"), F.lit(0)), (F.col("run") >= 0) & (F.col("band") < BAND)
    pieces = chunked(refs)
    own = reads.select(F.col("read_id").cast("long").alias("read_id"), F.upper("seq").alias("seq"))
    got = (chains if everything else chains.where(good)).join(own, "read_id")
    need = F.length("seq") + F.col("band") + F.least(F.col("a_start"), F.lit(0))
    sides = pieces.where("stretch = 0").select("ref_idx", F.col("len").alias("_len"), "back")
    got = got.join(sides, "ref_idx").withColumn("stretch", F.when(good, chunk_at(begin, need, F.col("_len"), F.col("back"))))
    pieces = pieces.select("ref_idx", "stretch", F.upper("seq").alias("template"))
    got = got.join(pieces, ["ref_idx", "stretch"], "left" if everything else "inner")
    first = begin_of(F.col("stretch"), F.col("back"), F.col("_len"), F.length("template"))
    at = (begin - first).cast("int")
    # a chunk that is read from its contig's end may begin after the template does, if the contig ends before it
    cut = F.col("template").substr(F.greatest(at, F.lit(0)) + 1, (need + F.least(at, F.lit(0))).cast("int"))
    lead = F.repeat(F.lit("@"), F.greatest(-F.col("a_start"), F.lit(0)).cast("int"))
    query = F.when(F.col("strand") == 1, reverse_complement("seq")).otherwise(F.col("seq"))
    return got.withColumn("template", F.concat(lead, cut)).withColumn("query", query).select(*chains.columns, "query", "template")


_FOUND = ["anchor_match", "anchor_mismatch", "sw_score", "n_match", "n_mismatch", "n_gap", "av_start", "av_stop", "ah_start", "ah_stop"]
_BLOCK = pa.list_(pa.struct([("v", pa.int32()), ("h", pa.int32()), ("size", pa.int32())]))


def _align(bisulfite: bool, d: int, columns: list[str]):
    def results(rows: list[dict]) -> list[tuple]:
        out: list[tuple] = [(None,) * (len(_FOUND) + 1)] * len(rows)
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if r["template"] is not None:
                by.setdefault(r["band"], []).append(i)
        for band, own in by.items():
            own.sort(key=lambda i: len(rows[i]["query"]))
            reads, refs = ([rows[i][c].encode("ascii", "replace") for i in own] for c in ("query", "template"))
            for i, q, t, (score, found) in zip(own, reads, refs, aligned(reads, refs, band, bisulfite), strict=True):
                r, f = rows[i], found or {}
                q, t = np.frombuffer(q, np.uint8), np.frombuffer(t.ljust(len(q) + band, b"@"), np.uint8)
                shift = r["window"] * d - r["a_start"]  # the template's place of the window's start
                hits = [equal(q[b["v"] : b["v"] + b["size"]], t[shift + b["h"] : shift + b["h"] + b["size"]], bisulfite) for b in r["blocks"]]
                good, all_ = sum(int(h.sum()) for h in hits), sum(map(len, hits))
                blocks = [{"v": v, "h": h, "size": n} for v, h, n in f["blocks"]] if f else None
                out[i] = (good, all_ - good, score, *[f.get(c) for c in ("n_match", "n_mismatch", "n_gap", "v_start", "v_stop", "h_start", "h_stop")], blocks)
        return out

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                cols = list(zip(*results(part.to_pylist()), strict=True))
                made = [pa.array(c, t) for c, t in zip(cols, [*[pa.int32()] * len(_FOUND), _BLOCK], strict=True)]
                yield pa.record_batch([*[part.column(c) for c in columns], *made], names=[*columns, *_FOUND, "ablocks"])

    return run


def align(candidates: DataFrame, d: int, bisulfite: bool = False) -> DataFrame:
    """Candidates, without their sequences, with matches and mismatches within the chain's blocks and the banded alignment.

    bisulfite: T in the read over C in the reference is a match, and identity is not asked for. Rows
    without a template get nulls.
    """
    kept = candidates.drop("query", "template")
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.IntegerType()) for c in _FOUND], T.StructField("ablocks", kept.schema["blocks"].dataType)])
    return candidates.mapInArrow(_align(bisulfite, d, kept.columns), schema)
