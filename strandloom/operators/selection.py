"""Which alignments of a read stay: running bests in scan order, then the final window filter."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Best:
    """What has been seen of a read so far."""

    anchor: int = 0
    skeleton: int = 0
    score: int = 0
    mappings: int = 0
    place: tuple = field(default=(None, 0))


#: What may become of a candidate: passed over with its group, or for want of a band; too many mismatches in its chain;
#: a skeleton under the best one's share; a score under the best one's share (predicted: its skeleton was low already);
#: an equal score too near the last one; a score under the span; or written. All from `predicted` on were aligned.
PASSED, POOR, SKELETON, PREDICTED, FAILED, NEAR, SHORT, WRITTEN = OUTCOMES = ("passed", "poor", "skeleton", "predicted", "failed", "near", "short", "written")


def outcomes(rows: list[dict], size: int, span: int, d: int, most: int, share: float) -> list[str]:
    """What becomes of the rows of one read, in scan order.

    A group is passed over if its chain is under three quarters of the best one, or if a perfect score
    has too many places already. A candidate is passed over if a quarter of its matches are mismatches, if
    its skeleton is under seven tenths of the best, or if its score is under the best one's share. An
    equal score counts again only where it lies apart from the last best place.
    """
    best, out, group, skip = Best(), [], None, False
    for r in rows:
        key = (r["ref_idx"], r["window"], r["strand"])
        if key != group:
            group = key
            skip = r["chain_score"] < best.anchor * 3 // 4
            if not skip:
                best.anchor = max(best.anchor, r["chain_score"])
                skip = best.score >= size and best.mappings > most
        if skip or r["run"] < 0 or r["sw_score"] is None:
            out.append(PASSED)
            continue
        if 4 * r["anchor_mismatch"] > r["anchor_match"]:
            out.append(POOR)
            continue
        skeleton = r["anchor_match"] - 3 * r["anchor_mismatch"]
        if skeleton < best.skeleton * 7 // 10:
            out.append(SKELETON)
            continue
        if r["sw_score"] < best.score * share:
            out.append(PREDICTED if skeleton < best.skeleton * 9 // 10 else FAILED)
            continue
        best.skeleton = max(best.skeleton, skeleton)
        start = r["window"] * d
        here = (r["ref_idx"], start + r["h_stop"] + span)
        if r["sw_score"] > best.score:
            best.score, best.mappings, best.place = r["sw_score"], 1, here
        elif r["sw_score"] == best.score:
            if best.place[0] == r["ref_idx"] and best.place[1] + size >= start + r["h_start"] + 1:
                out.append(NEAR)
                continue
            best.mappings, best.place = best.mappings + 1, here
        out.append(WRITTEN if r["sw_score"] >= span else SHORT)
    return out


def replay(rows: list[dict], size: int, span: int, d: int, most: int, share: float) -> list[bool]:
    """Which rows of one read, in scan order, are written."""
    return [o == WRITTEN for o in outcomes(rows, size, span, d, most, share)]


def decide(candidates: DataFrame, sizes: DataFrame, span: int, d: int, most: int = 1, top_percent: float = 1.0) -> DataFrame:
    """candidates with `outcome`, read by read. candidates: chains with alignments; sizes: read_id, size.

    A read's candidates are sorted by reference, window and strand within its group; their number is
    bounded by the windows it is chained in.
    """
    share = 1 - top_percent / 100
    order = [(c, "ascending") for c in ("ref_idx", "window", "strand", "run")]
    used = ["ref_idx", "window", "strand", "run", "chain_score", "h_start", "h_stop", "anchor_match", "anchor_mismatch", "sw_score"]

    def run(key, table):
        table = table.sort_by(order)
        told = outcomes(table.select(used).to_pylist(), table.column("size")[0].as_py(), span, d, most, share)
        return table.drop_columns(["size"]).append_column("outcome", pa.array(told, pa.string()))

    schema = T.StructType([*candidates.schema.fields, T.StructField("outcome", T.StringType())])
    return candidates.join(sizes.select("read_id", "size"), "read_id").select(*candidates.columns, "size").groupBy("read_id").applyInArrow(run, schema)


def select_in_order(candidates: DataFrame, sizes: DataFrame, span: int, d: int, most: int = 1, top_percent: float = 1.0) -> DataFrame:
    """Candidates that the scan would write."""
    return decide(candidates, sizes, span, d, most, top_percent).where(F.col("outcome") == WRITTEN).drop("outcome")


def final_filter(written: DataFrame, most: int = 1, top_percent: float = 1.0) -> DataFrame:
    """Rows within top_percent of their read's best score, of reads with no more than `most` such rows."""
    own = Window.partitionBy("read_id")
    top = written.withColumn("_best", F.max("sw_score").over(own)).where(F.col("sw_score") >= F.col("_best") * F.lit(1 - top_percent / 100))
    return top.withColumn("_n", F.count("*").over(own)).where(F.col("_n") <= most).drop("_best", "_n")
