"""Chains of collinear seed pairs within a read's window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.masks import Mask

MATCH, GAP, LEAST_SCORE = 2, 3, 10


class Chains:
    """Runs of linked pairs; a pair may be the end of one run and stand inside of others."""

    def __init__(self, mask: Mask):
        self.mask = mask

    def link(self, v: list[int], diag: list[int]) -> tuple[list[int], list[int], list[int]]:
        """For pairs in order of voff and hoff: each one's score and predecessor (-1), and the ends of runs.

        A pair looks down each run, from its end, for the first pair it can follow: one on its own
        diagonal, or one whose word ends before it. Following pays for the bases it adds, less the shift
        of diagonals. The best run wins, the eldest of equal ones; a pair that gains nothing starts a run.
        """
        mask, full = self.mask, MATCH * self.mask.weight
        score, before, ends = [], [], []
        for i in range(len(v)):
            top, source, run = 0, -1, -1
            for r, j in enumerate(ends):
                while j >= 0 and diag[j] != diag[i] and v[j] + mask.span > v[i]:
                    j = before[j]
                if j < 0:
                    continue
                shift = abs(diag[j] - diag[i])
                gained = score[j] + (full - GAP * shift if shift else MATCH * mask.gain(v[i] - v[j]))
                if gained > top:
                    top, source, run = gained, j, r
            if top > full:
                score.append(top)
                before.append(source)
                if ends[run] == source:
                    ends[run] = i
                else:
                    ends.append(i)
            else:
                score.append(full)
                before.append(-1)
                ends.append(i)
        return score, before, ends

    def best(self, v: list[int], h: list[int]) -> tuple[int, list[list[int]]]:
        """The best score, and the pairs of every run that has it, first to last."""
        score, before, ends = self.link(v, [b - a for a, b in zip(v, h, strict=True)])
        top = max(score[e] for e in ends)
        out = []
        for e in ends:
            if score[e] == top:
                run = []
                while e >= 0:
                    run.append(e)
                    e = before[e]
                out.append(run[::-1])
        return top, out


_KEYS = ["read_id", "strand", "ref_idx", "window"]
SCHEMA = "read_id long, strand int, ref_idx long, window long, run int, chain_score int, v_start int, h_start int, v_stop int, h_stop int, blocks array<struct<v:int,h:int,size:int>>"
_BLOCK = pa.list_(pa.struct([("v", pa.int32()), ("h", pa.int32()), ("size", pa.int32())]))


def _chain(mask: Mask):
    chains = Chains(mask)

    def rows_of(key: tuple, v: list[int], h: list[int]):
        top, runs = chains.best(v, h)
        if top < LEAST_SCORE:
            return
        n = 0
        for run in runs:
            if len(run) < 2:
                continue
            blocks: list[dict] = []
            for i in run:
                if blocks and blocks[-1]["h"] - blocks[-1]["v"] == h[i] - v[i]:
                    blocks[-1]["size"] = v[i] + mask.span - blocks[-1]["v"]
                else:
                    blocks.append({"v": v[i], "h": h[i], "size": mask.span})
            yield (*key, n, top, v[run[0]], h[run[0]], v[run[-1]], h[run[-1]], blocks)
            n += 1
        if not n:  # single pairs: no alignment, but their score counts
            yield (*key, -1, top, None, None, None, None, None)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 11
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, _BLOCK]
        names = [*_KEYS, "run", "chain_score", "v_start", "h_start", "v_stop", "h_stop", "blocks"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches):
        key, v, h, rows = None, [], [], []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in _KEYS]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.append(np.flatnonzero(change), batch.num_rows)
            vs, hs = batch.column("voff").to_pylist(), batch.column("hoff").to_pylist()
            a = 0
            for b in starts:
                if b > a:
                    now = tuple(int(c[a]) for c in cols)
                    if now != key and key is not None:
                        rows += rows_of(key, v, h)
                        v, h = [], []
                    key = now
                    v += vs[a:b]
                    h += hs[a:b]
                a = b
            if len(rows) > 5000:
                yield made(rows)
                rows = []
        if key is not None:
            rows += rows_of(key, v, h)
        yield made(rows)

    return run


def chain_pairs(pairs: DataFrame, mask: Mask) -> DataFrame:
    """The best chains of each read's strand in each window: run number, score, ends, and blocks of one diagonal.

    Groups whose best runs are single pairs give one row with run -1. Rows are dealt by group and sorted,
    so a task streams through groups, each of which is bounded by the limit on pairs.
    """
    dealt = pairs.select(*_KEYS, "voff", "hoff").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "voff", "hoff")
    return dealt.mapInArrow(_chain(mask), SCHEMA)
