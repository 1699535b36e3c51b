"""Queries over the driver's tables, and SQL that gives the same rows.

Documents are contigs and benchmark items are reads, by one projection of letters to bases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases as B
from ..functions.masks import STRIDES, Mask, parse_mask
from ..operators import frequency, pairs, seeds, variants
from ..sources.sequences import split_fastq
from . import engine_sql
from .mapper import Mapping, Options

MASK = parse_mask("12from18")
SMALL = parse_mask("8from14")
MAX_MAPPINGS = 20


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = B.dna("text")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("read_id"), F.concat(F.lit("item"), F.col("item_id")).alias("name"), seq.alias("seq"), F.repeat(F.lit("I"), F.length(seq)).alias("qual"))


def refs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ref_idx"), F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), B.dna("text").alias("seq"))


def seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents that share four forward seeds or more on a diagonal."""
    own = seeds.read_seeds(reads_of(spark, sf_dir), MASK).where("strand = 0")
    places = seeds.position_keys(refs_of(spark, sf_dir), MASK, presence=seeds.presence_map(own, MASK))
    hits = places.join(own, "key").groupBy("read_id", "ref_idx", (F.col("pos") - F.col("voff")).alias("diagonal")).agg(F.count("*").alias("n_seeds"))
    return hits.where("n_seeds >= 4").select(F.col("read_id").alias("item_id"), F.col("ref_idx").alias("doc_id"), "diagonal", "n_seeds")


def unique_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed hits within a hundredth of their item's best, of items with three such hits at most."""
    from ..operators.selection import final_filter

    hits = seed_hits(spark, sf_dir).select(F.col("item_id").alias("read_id"), "doc_id", "diagonal", F.col("n_seeds").alias("sw_score"))
    return final_filter(hits, most=3).select(F.col("read_id").alias("item_id"), "doc_id", "diagonal", F.col("sw_score").alias("n_seeds"))


def read_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.read_seeds(reads_of(spark, sf_dir), MASK)


def bisulfite_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.read_seeds(reads_of(spark, sf_dir), MASK, bisulfite=True)


def seed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.frequency_threshold(seeds.seed_counts(read_seeds(spark, sf_dir)), 99)


def pruned_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_seeds(spark, sf_dir)
    counts = seeds.seed_counts(own)
    return seeds.prune_seeds(own, seeds.kept_keys(counts, seeds.frequency_threshold(counts, 99))).select("read_id", "strand", "voff", "key", F.col("first").cast("int").alias("is_first"))


def kmer_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.kmer_frequencies(refs_of(spark, sf_dir), SMALL)


def kmer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.frequency_statistics(frequency.kmer_frequencies(refs_of(spark, sf_dir), MASK))


def ignore_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.ignore_keys(frequency.kmer_frequencies(refs_of(spark, sf_dir), MASK), most=12)


def ignore_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.pack_bits(ignore_keys(spark, sf_dir))


def ignore_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under 2 or over 12 of all keys of the pattern, keys that are not met among them."""
    freq = frequency.all_keys(spark, MASK, frequency.kmer_frequencies(refs_of(spark, sf_dir), MASK))
    return frequency.rejected(freq, frequency.ignore_keys(freq, least=2, most=12), MASK)


def unpacked_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.unpack_bits(ignore_bitmap(spark, sf_dir))


def filtered_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds whose keys are not ignored."""
    return seeds.read_seeds(reads_of(spark, sf_dir), MASK, ignore=ignore_keys(spark, sf_dir))


def mapping(spark: SparkSession, sf_dir: str, **options) -> Mapping:
    return Mapping(reads_of(spark, sf_dir), refs_of(spark, sf_dir), Options(max_mappings=MAX_MAPPINGS, **options))


def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping(spark, sf_dir).pairs()


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mapping(spark, sf_dir)
    return pairs.candidate_pairs(m.pairs(), m.d).groupBy("read_id", "strand", "ref_idx", "window").agg(F.max("n_pairs").alias("n_pairs"))


def _spelled(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of blocks as text, v:h:size of each; -1 and empty text where there is no chain or alignment (run, sw_score)."""
    spell = lambda b: F.concat_ws(":", b["v"].cast("string"), b["h"].cast("string"), b["size"].cast("string"))
    return df.withColumns({c: F.when(F.size(c) > 0, F.array_join(F.transform(c, spell), ",")) for c in columns}).fillna(-1).fillna("")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(mapping(spark, sf_dir).chains(), "blocks")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(mapping(spark, sf_dir).candidates(), "blocks", "ablocks")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping(spark, sf_dir).sam()


def bisulfite_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping(spark, sf_dir, bisulfite=True).sam()


def _called(m: Mapping, bisulfite: bool) -> DataFrame:
    return variants.call_variants(m.with_templates(m.mappings()), bisulfite)


def variant_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(mapping(spark, sf_dir), False)


def methylation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(mapping(spark, sf_dir, bisulfite=True), True)


def contig_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.coverage(mapping(spark, sf_dir).mappings())


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping(spark, sf_dir).counters()


def seeds_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read's seeds, and those of all reads."""
    own = mapping(spark, sf_dir).seeds_per_read()
    total = F.broadcast(own.agg(F.sum("seeds").alias("all_seeds")))  # one row
    return own.crossJoin(total)


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the sampled bases of each of an item's windows, decoded again, and functions of single bases and bits; pos is where a window starts."""
    starts = F.explode(F.sequence(F.lit(0), F.length("seq") - MASK.span)).alias("pos")
    windows = reads_of(spark, sf_dir).where(f"length(seq) >= {MASK.span}").select("read_id", "seq", starts).withColumn("window", F.substr("seq", F.col("pos") + 1, F.lit(MASK.span)))
    own = windows.withColumn("kmer", B.sampled("window", MASK)).withColumn("key", B.kmer_key("kmer"))
    return own.select(
        F.col("read_id").alias("item_id"),
        "pos",
        "kmer",
        "key",
        B.key_kmer("key", MASK.weight).alias("decoded"),
        B.base_at("key", 2).alias("third"),
        B.with_base_at("key", 2, "C").alias("with_third_c"),
        B.binary("key", 24).alias("bits"),
        B.base_number(F.substring("window", 1, 1)).alias("first_number"),
    )


def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of reverse complement of whole texts, of letters that are no bases among them, and the complement of each item's sequence."""
    ascii_only = F.regexp_replace("text", "[^ -~]", "-")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", B.reverse_complement(ascii_only).alias("strict"), B.reverse_complement_loose(ascii_only).alias("loose"), B.complement(B.dna("text")).alias("complement")
    )


def strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = reads_of(spark, sf_dir).withColumn("len", F.length("seq"))
    return own.select(F.col("read_id").alias("item_id"), "len", *[B.stride_of(s, "len").alias(s) for s in STRIDES])


def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contig's length and number of windows."""
    d = pairs.diagonals(reads_of(spark, sf_dir))
    own = refs_of(spark, sf_dir).select(F.col("ref_idx").alias("doc_id"), F.length("seq").cast("long").alias("len"))
    return own.crossJoin(F.broadcast(d)).select("doc_id", "len", F.when(F.col("len") > 0, F.floor((F.col("len") - 1) / F.col("d")) + 1).otherwise(0).cast("long").alias("windows"))  # d: one row


def doubled_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.doubled(refs_of(spark, sf_dir)).select("ref_idx", "name", F.length("seq").alias("len"), F.md5("seq").alias("md5"))


def split_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file each read goes to, seven to a file, in both ways of counting."""
    own = reads_of(spark, sf_dir).select((F.col("read_id") + 1).alias("read_id"))
    both = split_fastq(split_fastq(own, 7).withColumnRenamed("file", "plain"), 7, compat=True)
    return both.select("read_id", "plain", F.col("file").alias("compat"))


# ---- the same in SQL -------------------------------------------------------------------------------------


def _dna(text: str = "text") -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{B.LETTERS}', '{B.PROJECTION}')"


READS = f"r AS (SELECT item_id read_id, {_dna()} seq FROM benchmark)"
REFS = f"g AS (SELECT doc_id ref_idx, {_dna()} seq FROM documents)"


def _keys(name: str, source: str, key: str, columns: str, mask: Mask, extra: str = "") -> str:
    """A view of the keys at all places of sequences; a row for each base, then leads."""
    terms = " + ".join(f"lead(c, {o}) OVER w * {4**i}" for i, o in enumerate(mask.offsets))
    return f"""{name}_c AS (SELECT {columns}, length(seq) n, unnest(range(length(seq))) pos, strpos('ATGC', unnest(string_split(seq, ''))) - 1 c FROM {source} WHERE length(seq) >= {mask.span}),
{name} AS (SELECT * FROM (SELECT {columns}, pos, n, CAST({terms} AS BIGINT) key{extra} FROM {name}_c WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE pos + {mask.span} <= n)"""


def _stride(n: str, sensitivity: str = "medium") -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {m} THEN {s}" if m else f"ELSE {s}" for m, s in STRIDES[sensitivity]) + " END"


STRANDS = "s2 AS (SELECT read_id, 0 strand, seq FROM r UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM r WHERE length(seq) > 0)"
SEEDS = f"{READS}, {STRANDS}, {_keys('k', 's2', 'read_id, strand', 'read_id, strand', MASK)}, seeds AS (SELECT read_id, strand, CAST(pos AS INT) voff, key FROM k WHERE pos % {_stride('n')} = 0)"
COUNTS = f"{SEEDS}, counts AS (SELECT key, count(*) n FROM seeds GROUP BY key)"
THRESHOLD = f"""{COUNTS}, bins AS (SELECT least(n // 2, 249999) r, sum(n) s FROM counts GROUP BY 1),
cum AS (SELECT r, sum(s) OVER (ORDER BY r) c, sum(s) OVER () total FROM bins),
limits AS (SELECT CAST(2 * min(r) + 1 AS BIGINT) threshold FROM cum WHERE c >= total * CAST(0.99 AS DOUBLE))"""
PRUNED = f"{THRESHOLD}, pruned AS (SELECT read_id, strand, voff, key, row_number() OVER (PARTITION BY key ORDER BY read_id, strand, voff) = 1 is_first FROM seeds JOIN counts USING (key) WHERE n <= (SELECT threshold FROM limits))"
PAIRS = f"""{PRUNED}, {REFS}, {_keys("p", "g", "ref_idx", "ref_idx", MASK)},
d AS (SELECT greatest(100, max(length(seq))) d FROM r WHERE length(seq) <= 2000),
hit AS (SELECT x.*, p.ref_idx, p.pos, p.n len, unnest([p.pos // d, p.pos // d - 1]) w, d FROM p JOIN pruned x USING (key), d WHERE p.key <> 0),
near AS (SELECT *, pos - d * w hoff FROM hit WHERE w >= 0 AND pos + {MASK.span} - 1 <= least(d * w + 2 * d - 1, len - 1)),
allowed AS (SELECT *, row_number() OVER (PARTITION BY read_id, strand, ref_idx, w ORDER BY voff, hoff) i FROM near WHERE is_first OR (hoff <= voff + d + 10 AND voff <= d + 10)),
pairs AS (SELECT read_id, strand, ref_idx, w, voff, hoff, hoff - voff diagonal, d FROM allowed WHERE i = 1 OR hoff >= voff)"""


_STEPS = "list_filter([" + ", ".join(f"CASE WHEN (key >> {2 * i}) & 3 = 1 THEN {2 << 2 * i} END" for i in range(MASK.weight)) + "], lambda x: x IS NOT NULL)"
BISULFITE_SEEDS = f"""{SEEDS}, steps AS (SELECT *, {_STEPS} st FROM seeds WHERE strand = 0),
picks AS (SELECT read_id, strand, voff, key, st, unnest(list_distinct(range(least(CAST(2 ** len(st) AS BIGINT), 512)) || [CAST(2 ** len(st) AS BIGINT) - 1])) pick FROM steps),
expanded AS (SELECT read_id, strand, voff, CAST(key + coalesce(list_sum([CASE WHEN (pick >> (len(st) - j)) & 1 = 0 THEN st[j] ELSE 0 END FOR j IN range(1, len(st) + 1)]), 0) AS BIGINT) key FROM picks)"""
DOUBLED = f"{REFS.replace('g AS', 'one AS', 1)}, g AS (SELECT 2 * ref_idx - 1 ref_idx, seq FROM one UNION ALL SELECT 2 * ref_idx, reverse(translate(seq, 'ACGT', 'TGCA')) FROM one)"
BISULFITE_PAIRS = BISULFITE_SEEDS + PAIRS[len(SEEDS) :].replace("FROM seeds", "FROM expanded").replace(REFS, DOUBLED)


def _freq(mask: Mask) -> str:
    back = " + ".join(f"lead(xor(c, 1), {mask.span - 1 - o}) OVER w * {4**i}" for i, o in enumerate(mask.offsets))
    return f"{REFS}, {_keys('f', 'g', 'ref_idx', 'ref_idx', mask, f', CAST({back} AS BIGINT) back')}, freq AS (SELECT key, count(*) freq FROM (SELECT key FROM f UNION ALL SELECT back FROM f) GROUP BY key)"


_HITS = f"{SEEDS}, {REFS}, {_keys('p', 'g', 'ref_idx', 'ref_idx', MASK)}, hits AS (SELECT read_id item_id, ref_idx doc_id, pos - voff diagonal, count(*) n_seeds FROM p JOIN seeds USING (key) WHERE strand = 0 AND p.key <> 0 GROUP BY ALL HAVING count(*) >= 4)"
_DECODE = " || ".join(f"substr('ATGC', CAST((key >> {2 * i}) & 3 AS INT) + 1, 1)" for i in range(MASK.weight))
_DECODE_SMALL = " || ".join(f"substr('ATGC', CAST((key >> {2 * i}) & 3 AS INT) + 1, 1)" for i in range(SMALL.weight))
_WINDOW_SAMPLED = " || ".join(f"substr(seq, pos + {o + 1}, 1)" for o in MASK.offsets)
_WHOLE = "regexp_replace(text, '[^ -~]', '-', 'g')"

SQL = {
    "seed_hits": f"WITH {_HITS} SELECT * FROM hits",
    "unique_hits": f"WITH {_HITS}, t AS (SELECT *, max(n_seeds) OVER (PARTITION BY item_id) b FROM hits), u AS (SELECT *, count(*) OVER (PARTITION BY item_id) k FROM t WHERE n_seeds >= b * CAST(0.99 AS DOUBLE)) SELECT item_id, doc_id, diagonal, n_seeds FROM u WHERE k <= 3",
    "read_seeds": f"WITH {SEEDS} SELECT * FROM seeds",
    "bisulfite_seeds": f"WITH {BISULFITE_SEEDS} SELECT * FROM expanded",
    "seed_threshold": f"WITH {THRESHOLD} SELECT (SELECT count(*) FROM counts) distinct_keys, CAST((SELECT sum(n) FROM counts) AS BIGINT) total, (SELECT max(n) FROM counts) max_count, threshold FROM limits",
    "pruned_seeds": f"WITH {PRUNED} SELECT read_id, strand, voff, key, CAST(is_first AS INT) is_first FROM pruned",
    "kmer_frequencies": f"WITH {_freq(SMALL)} SELECT key, {_DECODE_SMALL} kmer, freq FROM freq",
    "kmer_statistics": f"WITH {_freq(MASK)} SELECT count(*) distinct_keys, CAST(sum(freq) AS BIGINT) total, min(freq) min_freq, max(freq) max_freq, CAST(floor(sum(freq) / count(*)) AS BIGINT) mean_freq, CAST(floor(median(freq)) AS BIGINT) median_freq FROM freq",
    "ignore_keys": f"WITH {_freq(MASK)} SELECT key FROM freq WHERE freq > 12",
    "ignore_bitmap": f"WITH {_freq(MASK)} SELECT key // 8 AS byte, CAST(sum(1 << (key % 8)) AS INT) AS value FROM freq WHERE freq > 12 GROUP BY 1",
    "ignore_share": f"WITH {_freq(MASK)}, j AS (SELECT count(*) FILTER (freq < 2 OR freq > 12) + {4**MASK.weight} - count(*) k FROM freq) SELECT k rejected_keys, CAST({4**MASK.weight} AS BIGINT) all_keys, floor(k * 10000 / {4**MASK.weight}) / 100 rejected_percent FROM j",
    "unpacked_bitmap": f"WITH {_freq(MASK)} SELECT key FROM freq WHERE freq > 12",
    "filtered_seeds": f"WITH {SEEDS}, {_freq(MASK)} SELECT * FROM seeds WHERE key NOT IN (SELECT key FROM freq WHERE freq > 12)",
    "window_pairs": f'WITH {PAIRS} SELECT read_id, strand, ref_idx, w AS "window", voff, hoff, diagonal FROM pairs',
    "candidate_groups": f'WITH {PAIRS} SELECT read_id, strand, ref_idx, w AS "window", count(*) n_pairs FROM pairs GROUP BY ALL HAVING count(*) > 1 AND count(*) < any_value(d) // 6 * 5',
    "scalar_functions": f"""WITH {READS}, w AS (SELECT read_id item_id, seq, CAST(unnest(range(length(seq) - {MASK.span - 1})) AS INT) pos FROM r WHERE length(seq) >= {MASK.span}), s AS (SELECT *, {_WINDOW_SAMPLED} kmer FROM w),
t AS (SELECT *, CAST({" + ".join(f"(strpos('ATGC', substr(kmer, {i + 1}, 1)) - 1) * {4**i}" for i in range(MASK.weight))} AS BIGINT) key FROM s)
SELECT item_id, pos, kmer, key, {_DECODE} decoded, substr('ATGC', CAST((key >> 4) & 3 AS INT) + 1, 1) third, key | 48 with_third_c, lpad(bin(key), 24, '0') bits, strpos('ATGC', substr(seq, pos + 1, 1)) - 1 first_number FROM t""",
    "reverse_complements": f"SELECT item_id, reverse(translate(regexp_replace(upper({_WHOLE}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) strict, reverse(translate({_WHOLE}, 'AaCcGgTtn', 'TTGGCCAAN')) loose, translate({_dna()}, 'ACGT', 'TGCA') complement FROM benchmark",
    "chains": f"WITH RECURSIVE {engine_sql.chains(PAIRS, MASK)} SELECT {engine_sql.CHAIN_COLUMNS} FROM chain LEFT JOIN blocks USING ({engine_sql.KEYS}, run)",
    "alignments": f"WITH RECURSIVE {engine_sql.candidates(PAIRS, MASK, False)} SELECT {engine_sql.ALIGNMENT_COLUMNS} FROM cand LEFT JOIN blocks USING ({engine_sql.KEYS}, run) LEFT JOIN ablocks USING (id)",
    "mappings": engine_sql.sam(PAIRS, MASK, False, MAX_MAPPINGS),
    "bisulfite_mappings": engine_sql.sam(BISULFITE_PAIRS, MASK, True, MAX_MAPPINGS),
    "variant_calls": engine_sql.calls(PAIRS, MASK, False, MAX_MAPPINGS),
    "methylation_calls": engine_sql.calls(BISULFITE_PAIRS, MASK, True, MAX_MAPPINGS),
    "contig_coverage": f"WITH RECURSIVE {engine_sql.mappings(PAIRS, MASK, False, MAX_MAPPINGS)} SELECT ref_idx, count(DISTINCT id) mappings, CAST(sum(size) AS BIGINT) bases FROM (SELECT id, ref_idx FROM mapping) JOIN (SELECT id, size FROM ablock) USING (id) GROUP BY ref_idx",
    "run_counters": f"WITH RECURSIVE {engine_sql.outcomes(PAIRS, MASK, False, MAX_MAPPINGS)} SELECT {engine_sql.COUNTERS} FROM outcome",
    "seeds_per_read": f"WITH {SEEDS}, own AS (SELECT r.read_id, count(seeds.key) seeds FROM r LEFT JOIN seeds USING (read_id) WHERE length(r.seq) <= 2000 GROUP BY ALL) SELECT read_id, seeds, CAST(sum(seeds) OVER () AS BIGINT) all_seeds FROM own",
    "strides": f"WITH {READS} SELECT read_id item_id, length(seq) len, {', '.join(f'{_stride("length(seq)", s)} AS {s}' for s in STRIDES)} FROM r",
    "sequence_windows": f"WITH {READS}, {REFS}, d AS (SELECT greatest(100, max(length(seq))) d FROM r WHERE length(seq) <= 2000) SELECT ref_idx doc_id, length(seq) len, CASE WHEN length(seq) > 0 THEN (length(seq) - 1) // d + 1 ELSE 0 END windows FROM g, d",
    "doubled_reference": f"WITH {REFS}, t AS (SELECT 2 * ref_idx - 1 ref_idx, 'doc' || ref_idx AS name, seq FROM g UNION ALL SELECT 2 * ref_idx, '{B.RC_PREFIX}doc' || ref_idx, reverse(translate(seq, 'AaCcGgTtn', 'TTGGCCAAN')) FROM g) SELECT ref_idx, name, length(seq) len, md5(seq) md5 FROM t",
    "split_reads": "SELECT item_id + 1 read_id, item_id // 7 plain, CASE WHEN item_id < 7 THEN 0 ELSE (item_id - 7) // 8 + 1 END compat FROM benchmark",
}

QUERIES = {
    f.__name__: f
    for f in (
        seed_hits, unique_hits, read_seeds, bisulfite_seeds, seed_threshold, pruned_seeds, filtered_seeds, kmer_frequencies, kmer_statistics, ignore_keys, ignore_bitmap, unpacked_bitmap, ignore_share,
        window_pairs, candidate_groups, chains, alignments, mappings, bisulfite_mappings, variant_calls, methylation_calls, contig_coverage, run_counters, seeds_per_read,
        scalar_functions, reverse_complements, strides, sequence_windows, doubled_reference, split_reads,
    )
}
