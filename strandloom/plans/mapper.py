"""The mapping plan: reads against references, from seeds to SAM columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Mask, parse_mask
from ..operators import alignment, chains, pairs, reference, sam, seeds, selection
from ..operators.scratch import Scratch


@dataclass(frozen=True)
class Options:
    """What can be set. keep_percent None: 99, or 93 for the sensitivity `fast`; it is clamped to 90 to 100."""

    pattern: str = "12from18"
    sensitivity: str = "medium"
    max_mappings: int = 1
    top_percent: float = 1.0
    keep_percent: int | None = None
    bisulfite: bool = False

    @property
    def mask(self) -> Mask:
        return parse_mask(self.pattern)

    @property
    def kept(self) -> int:
        return self.keep_percent if self.keep_percent is not None else 93 if self.sensitivity == "fast" else 99


class Mapping:
    """Steps of one mapping as DataFrames; each is planned when asked for.

    refs: contigs (ref_idx, name, seq), or their chunks (operators.reference). places: stored places of these chunks,
    of both strands' contigs in bisulfite mode, in place of a scan.
    """

    def __init__(self, reads: DataFrame, refs: DataFrame, options: Options = Options(), ignore: DataFrame | None = None, places: DataFrame | None = None):  # noqa: B008
        from ..shipping import ship

        ship(reads.sparkSession)
        self.options, self.mask = options, options.mask
        self.reads = reads.where("length(seq) <= 2000").select(F.col("read_id").cast("long").alias("read_id"), "name", "seq", "qual")
        self.refs = reference.doubled(reference.chunked(refs)) if options.bisulfite else reference.chunked(refs)
        self.ignore, self.places = ignore, places
        self.d = int(pairs.diagonals(self.reads).first()["d"])

    @cached_property
    def _seeds(self) -> tuple[DataFrame, DataFrame]:
        """The reads' seeds, and the keys that stay; both are written, as counts, the scan's map and the join read them."""
        scratch = Scratch(self.reads.sparkSession, "mapping")
        own = seeds.read_seeds(self.reads, self.mask, self.options.sensitivity, self.options.bisulfite, self.ignore)
        own = scratch.table(own, "seeds")
        counts = scratch.table(seeds.seed_counts(own), "counts")
        return own, seeds.kept_keys(counts, seeds.frequency_threshold(counts, self.options.kept))

    def seeds(self) -> DataFrame:
        """Seeds whose keys are neither ignored nor too frequent."""
        return seeds.prune_seeds(*self._seeds)

    def pairs(self) -> DataFrame:
        own, kept = self._seeds
        places = self.places if self.places is not None else seeds.position_keys(self.refs, self.mask, presence=seeds.presence_map(kept, self.mask))
        if self.ignore is not None and self.options.bisulfite:  # expanded keys may be ignored ones
            places = places.join(self.ignore.select("key"), "key", "left_anti")
        return pairs.window_pairs(pairs.seed_matches(seeds.prune_seeds(own, kept), places), reference.contigs(self.refs), self.d, self.mask)

    def chains(self) -> DataFrame:
        return alignment.placed(chains.chain_pairs(pairs.candidate_pairs(self.pairs(), self.d), self.mask), self.d)

    def candidates(self) -> DataFrame:
        """Chains with the alignment of those whose band is narrow enough."""
        return alignment.align(alignment.with_templates(self.chains(), self.refs, self.reads, everything=True), self.d, self.options.bisulfite)

    def decided(self, candidates: DataFrame | None = None) -> DataFrame:
        """Candidates with what becomes of each in scan order."""
        o = self.options
        sizes = self.reads.select("read_id", F.length("seq").alias("size"))
        return selection.decide(candidates if candidates is not None else self.candidates(), sizes, self.mask.span, self.d, o.max_mappings, o.top_percent)

    def mappings(self, candidates: DataFrame | None = None) -> DataFrame:
        """The alignments that stay."""
        written = self.decided(candidates).where(F.col("outcome") == selection.WRITTEN).drop("outcome")
        return selection.final_filter(written, self.options.max_mappings, self.options.top_percent)

    def with_templates(self, mappings: DataFrame) -> DataFrame:
        return alignment.with_templates(mappings, self.refs, self.reads)

    def sam(self, mappings: DataFrame | None = None) -> DataFrame:
        return sam.to_sam(mappings if mappings is not None else self.mappings(), self.reads, self.refs, self.options.bisulfite)

    def counters(self, candidates: DataFrame | None = None) -> DataFrame:
        """One row of totals of the scan: groups that were chained; candidates that were aligned, and of these those under
        the best score's share, with those whose skeleton told so; chains that mismatch too much; skeletons under the
        best one's share."""
        seen = self.decided(candidates)
        count = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
        s = selection
        return seen.agg(
            F.count(F.when(F.col("run") <= 0, 1)).alias("anchorings"),
            count(s.PREDICTED, s.FAILED, s.NEAR, s.SHORT, s.WRITTEN).alias("alignments"),
            count(s.PREDICTED, s.FAILED).alias("failed_alignments"),
            count(s.POOR).alias("poor_anchorings"),
            count(s.PREDICTED).alias("predicted_by_skeleton"),
            count(s.SKELETON).alias("under_skeleton"),
        )

    def seeds_per_read(self) -> DataFrame:
        """(read_id, seeds): the seeds of each read that the ignore list leaves, before pruning; 0 for reads without any."""
        o = self.options
        own = seeds.read_seeds(self.reads, self.mask, o.sensitivity, o.bisulfite, self.ignore).groupBy("read_id").agg(F.count("*").alias("seeds"))
        return self.reads.select("read_id").join(own, "read_id", "left").select("read_id", F.coalesce("seeds", F.lit(0)).cast("long").alias("seeds"))


def map_reads(reads: DataFrame, refs: DataFrame, options: Options = Options(), ignore: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """SAM columns of reads (read_id, name, seq, qual) mapped to refs (ref_idx, name, seq)."""
    return Mapping(reads, refs, options, ignore).sam()
