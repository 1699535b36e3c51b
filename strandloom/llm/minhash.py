"""MinHash near-dedup: minima, bands, signature and full-set checks, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, plan_bytes, split_join, spread
from .graph import components
from .shingles import mix, shingle_sets

#: A pair at similarity s shares no band of r minima with probability (1 - s ** r) ** 32: under 3e-7 for
#: 0.85 and 6, 4e-6 for 0.8 and 5.
BANDS, ROWS = 32, 6
#: Share of equal minima under which a pair's full sets are not compared; five standard deviations under 0.85.
SLACK = 0.15
#: Bits of each minimum in the signature that candidates are held against, and how many standard deviations a pair may
#: stay under what the bound gives: one in three million pairs at the bound does.
SIGNATURE_BITS, DEVIATIONS = 4, 5
#: Texts and bytes that a unit of verification holds at most, on each of its two sides.
BLOCK_ROWS, BLOCK_BYTES = 4096, 12 << 20
#: Signatures of a bucket on each side of a unit.
SIGNATURE_ROWS = 2048
#: Bytes of a table of bits that full sets of a block are compared by.
BITS_BYTES = 48 << 20
#: Bytes of small families that are verified in one go.
UNIT_BYTES = 4 << 20

_rng = np.random.default_rng(31)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def rows_for(percent: int) -> int:
    """Minima in a band: fewer for lower similarities, so that pairs at the bound still meet."""
    return next((r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** BANDS < 5e-6), 1)


def minima(sets: list[np.ndarray], rows: int = ROWS) -> np.ndarray:
    """The least value of each universal hash over each non-empty set: one row for each set."""
    out = np.empty((len(sets), BANDS * rows), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 200_000):
            size += len(sets[end])
            end += 1
        starts = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * rows):
            out[at:end, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
        at = end
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(m), BANDS)).copy()
    by = m.reshape(len(m), BANDS, -1)
    for r in range(by.shape[2]):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + by[:, :, r])
    return keys.view(np.int64)


def set_key(s: np.ndarray) -> int:
    """Half of what names a set."""
    return int(np.bitwise_xor.reduce(mix(s))) - (1 << 63)


def signature(m: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, two to a byte."""
    low = (m & np.uint32((1 << SIGNATURE_BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] << SIGNATURE_BITS | low[:, 1::2]


def equal_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima agree in rows of two signatures."""
    x = a ^ b
    return ((x >> SIGNATURE_BITS) == 0).sum(-1) + ((x & ((1 << SIGNATURE_BITS) - 1)) == 0).sum(-1)


def enough(n: int, percent: int) -> float:
    """Minima out of n that agree in nearly all pairs at the bound, chance agreement of so few bits included."""
    q = percent / 100 + (1 - percent / 100) / (1 << SIGNATURE_BITS)
    return n * q - DEVIATIONS * (n * q * (1 - q)) ** 0.5


def _describe(width: int, rows: int):
    names = ["doc_id", "n_shingles", "n_bytes", "k1", "k2", "bands", "signature"]

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a in range(0, len(texts), 1000):
                sets = shingle_sets(texts[a : a + 1000], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                n = len(sets)
                bands, signatures = [None] * n, [None] * n
                if full:
                    m = minima([sets[i] for i in full], rows)
                    for i, key, own in zip(full, band_keys(m), signature(m), strict=True):
                        bands[i], signatures[i] = key.tobytes(), own.tobytes()
                k1 = [set_key(s) if len(s) else None for s in sets]
                k2 = [int(mix(s + np.uint64(77)).sum()) - (1 << 63) if len(s) else None for s in sets]
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([len(t) for t in texts[a : a + 1000]], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.binary()), pa.array(signatures, pa.binary())]
                yield pa.record_batch([batch.column("doc_id").slice(a, n), *cols], names=names)

    return run


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _judge(percent: int):
    """Pairs (u, v) with both signatures: whether they may reach the bound."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column("su")), _matrix(batch.column("sv"))
                near = equal_minima(a, b) >= enough(2 * a.shape[1], percent)
                yield pa.record_batch([batch.column("u"), batch.column("v"), pa.array(near)], names=["u", "v", "near"])

    return run


def likely(sigs: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what all pairs of signatures that may reach the bound join; sides as in linked."""
    forest, out, least = Forest(len(sigs)), [], enough(2 * sigs.shape[1], percent)
    for i in range(len(sigs) - 1):
        js = np.arange(i + 1, len(sigs))
        js = js[(side[js] != side[i]) | (side[js] == 2)]
        if len(js) > 64:
            js = js[forest.roots()[js] != forest.root(i)]
        for j in js[equal_minima(sigs[js], sigs[i]) >= least].tolist():
            if (r := forest.root(j)) != (s := forest.root(i)):
                forest.up[max(r, s)] = min(r, s)
                out.append((i, j))
    return out


def _likely(percent: int):
    def run(key, table):
        ids, bucket, side = (table.column(c).to_numpy() for c in ("doc_id", "key", "side"))
        sigs = _matrix(table.column("signature"))
        order = np.argsort(bucket, kind="stable")
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]))
        pairs = [(ids[rows[i]], ids[rows[j]]) for rows in (order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)) for i, j in likely(sigs[rows], side[rows], percent)]
        return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})

    return run


def _unpack(batches):
    """A row (key, doc_id) for each band."""
    for batch in batches:
        raw = batch.column("bands").to_pylist()
        if raw:
            keys = np.frombuffer(b"".join(raw), np.int64)
            ids = np.repeat(np.array(batch.column("doc_id").to_pylist(), np.int64), BANDS)
            yield pa.record_batch([pa.array(keys), pa.array(ids)], names=["key", "doc_id"])


class Forest:
    """Union by least id, within one unit."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def overlaps(sets: list[np.ndarray]):
    """A function (i, some) to the sizes of set i's intersections with some sets.

    Sets become rows of bits over the members that two sets have, where such a table is no larger than
    BITS_BYTES; else members are looked up.
    """
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))
    _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1
    words = int(common.sum()) // 64 + 1
    if len(sets) > 8 and len(sets) * words * 8 <= BITS_BYTES:
        place = np.cumsum(common) - 1
        use = common[back]
        row, at = np.repeat(np.arange(len(sets)), sizes)[use], place[back[use]]
        bits = np.zeros((len(sets), words), np.uint64)
        np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return lambda i, some: np.bitwise_count(bits[some] & bits[i]).sum(1, dtype=np.int64)

    def looked_up(i, some):
        cat = np.concatenate([flat[starts[j] : starts[j + 1]] for j in some])
        at = np.searchsorted(sets[i], cat)
        hit = sets[i][np.minimum(at, sizes[i] - 1)] == cat
        return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *sizes[some[:-1]]]))

    return looked_up


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what the sets' full links join, found without listing all pairs.

    side: 0 and 1 for two blocks, between which alone links are looked for, or all 2 for one block.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    sig = (minima(sets) & np.uint32(255)).astype(np.uint8)
    shared = overlaps(sets)
    forest, out = Forest(n), []
    least = (percent / 100 - SLACK) * BANDS * ROWS
    for i in range(n - 1):
        roots = forest.roots()
        js = np.arange(i + 1, n)
        small, large = np.minimum(sizes[i], sizes[js]), np.maximum(sizes[i], sizes[js])
        js = js[(roots[js] != roots[i]) & ((side[js] != side[i]) | (side[js] == 2)) & (100 * small >= percent * large)]
        if not len(js):
            continue
        equal = (sig[js] == sig[i]).sum(1)
        js = js[equal >= least]
        js = js[np.argsort(-equal[equal >= least], kind="stable")]
        for a in range(0, len(js), 64):  # the likeliest first: their links spare others
            some = [j for j in js[a : a + 64] if forest.root(j) != forest.root(i)]
            if not some:
                continue
            for j, x in zip(some, shared(i, some).tolist(), strict=True):
                if 100 * x >= percent * (sizes[i] + sizes[j] - x) and (r := forest.root(j)) != (s := forest.root(i)):
                    forest.up[max(r, s)] = min(r, s)
                    out.append((i, j))
    return out


def _verify(width: int, percent: int):
    def run(key, table):
        ids, texts = table.column("doc_id").to_numpy(), table.column("text").to_pylist()
        family, side, named = (table.column(c).to_numpy() for c in ("family", "side", "k1"))
        order = np.argsort(family, kind="stable")
        u, v = [], []
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(family[order])) + 1, [len(order)]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = order[a:b]
            sets = shingle_sets([(texts[r] or "").encode() for r in rows], width) if len(rows) > 1 else []
            # a row of a member's id may have another text, and then is no member
            full = [k for k, s in enumerate(sets) if len(s) and set_key(s) == named[rows[k]]]
            if len(full) > 1:
                rows = rows[full]
                for i, j in linked([sets[k] for k in full], side[rows], percent):
                    u.append(ids[rows[i]])
                    v.append(ids[rows[j]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _units(rows: DataFrame, group: str, parts, units: int) -> DataFrame:
    """rows with unit and side: small groups share `units` units; a group of several parts is dealt to these, of which each two meet."""
    own = rows.withColumn("_parts", parts.cast("int")).withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))
    small = F.array(F.struct(F.concat(F.lit("f"), F.pmod(F.xxhash64(group), F.lit(units)).cast("string")).alias("unit"), F.lit(2).alias("side")))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda o: F.struct(
            F.concat_ws(":", F.col(group).cast("string"), F.least("_own", o).cast("string"), F.greatest("_own", o).cast("string")).alias("unit"),
            F.when(F.col("_own") == o, 2).when(F.col("_own") < o, 0).otherwise(1).alias("side"),
        ),
    )
    return own.withColumn("in", F.when(F.col("_parts") == 1, small).otherwise(meets)).drop("_parts", "_own")


def candidates(classes: DataFrame, percent: int, units: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between classes (rep, bands, signature) that share a band and whose signatures may reach the bound.

    They join what all such pairs join. In each band's bucket all members are held against the least one; where some
    fail, the bucket's signatures are compared by themselves, large buckets in blocks of which each two meet. So
    texts that only meet by a band, as very many do in a large collection, do not end up in one family.
    """
    keyed = classes.select("rep", "bands").withColumnRenamed("rep", "doc_id").mapInArrow(_unpack, "key long, doc_id long")
    keyed = scratch.table(keyed, "keys", "lz4")
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    met = scratch.table(split_join(scratch, keyed, shared, ["key"]), "met", "lz4")
    scratch.drop(keyed)
    pairs = met.where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v")).distinct()
    known = classes.select(F.col("rep").alias("u"), F.col("signature").alias("su"))
    both = pairs.join(known, "u").join(known.withColumnsRenamed({"u": "v", "su": "sv"}), "v")
    judged = scratch.table(both.select("u", "v", "su", "sv").mapInArrow(_judge(percent), "u long, v long, near boolean"), "judged")
    far = judged.where("not near").select(F.col("u").alias("doc_id"), F.col("v").alias("first"))
    mixed = met.join(far, ["doc_id", "first"]).select("key").distinct()
    rest = split_join(scratch, met.select("key", "doc_id", "n"), mixed, ["key"])
    rest = scratch.table(rest.join(known.withColumnsRenamed({"u": "doc_id", "su": "signature"}), "doc_id"), "mixed", "lz4")
    dealt = _units(rest, "key", F.ceil(F.col("n") / SIGNATURE_ROWS), 16 * units)
    work = dealt.select("key", "doc_id", "signature", F.explode("in").alias("m")).select("key", "doc_id", "signature", "m.unit", "m.side")
    links = work.groupBy("unit").applyInArrow(_likely(percent), "u long, v long")
    out = scratch.table(judged.where("near").select("u", "v").unionByName(links), "candidates")
    for t in (met, judged, rest):
        scratch.drop(t)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Words are runs of non-space bytes, A-Z read as a-z; a text's set is its distinct `width`-word
    shingles, the whole for fewer words. Rows link where 100 * shared >= percent * united.

    Rows of equal sets are one class, so copies are compared once. Classes that share a band are candidates if their
    signatures allow for the bound; candidates make up families (components, not all pairs). Each family is verified
    on full sets; small families share a unit of work, and a family beyond a unit's bounds is dealt to blocks, of
    which each two meet in a unit: work and memory of a task stay bounded and no link is left out. Verified
    links go to large-star and small-star again.

    Null or wordless text: no shingles, linked with nothing. Rows are nodes: those of one id may lie
    in different components. A row with null id links nothing and has null component_id. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    given = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    described = scratch.table(given.mapInArrow(_describe(width, rows_for(percent)), "doc_id long, n_shingles long, n_bytes long, k1 long, k2 long, bands binary, signature binary"), "described")
    named = described.where("doc_id is not null and k1 is not null")
    of_any = [F.first(c).alias(c) for c in ("bands", "signature")]
    classes = scratch.table(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), *of_any, F.max("n_bytes").alias("n_bytes")), "classes")
    units = max(16, plan_bytes(docs) // UNIT_BYTES)
    families = scratch.table(components(candidates(classes, percent, units, scratch), scratch), "families")

    sized = families.join(classes.select(F.col("rep").alias("id"), "n_bytes", "k1"), "id").withColumnsRenamed({"id": "doc_id", "component": "family"})
    sized = scratch.table(sized, "sized")
    totals = sized.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    members = _units(split_join(scratch, sized, totals, ["family"]), "family", parts, units).select("doc_id", "family", "k1", "in")
    texts = scratch.table(given.join(members, "doc_id"), "members")
    work = texts.select("doc_id", "family", "k1", "text", F.explode("in").alias("m")).select("doc_id", "family", "k1", "text", "m.unit", "m.side")
    links = work.groupBy("unit").applyInArrow(_verify(width, percent), "u long, v long")
    joined = scratch.table(components(scratch.table(links, "links"), scratch), "components")

    told = classes.select("k1", "k2", "rep").join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    told = told.select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    rows = described.select("doc_id", "n_shingles", "k1", "k2")
    linked = split_join(scratch, rows.where("k1 is not null"), told, ["k1", "k2"], "left").select("doc_id", "n_shingles", "component")
    out = linked.unionByName(rows.where("k1 is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


QUERIES = {"op3_minhash": op3_minhash}
SQL = {
    "op3_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a id, a c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) c FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) n_shingles, least(coalesce(m.c, w.doc_id), w.doc_id) component_id, least(coalesce(m.c, w.doc_id), w.doc_id) = w.doc_id kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id"""
}
