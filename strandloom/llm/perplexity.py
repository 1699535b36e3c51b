"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted texts.

Counts, model and queries are dealt to shards by language and the two last bytes of the context. All
longer contexts of a byte, their continuation counts and backed-off orders are then in one shard; what
shards share (orders one and two, discounts) is a table of at most 65 536 entries a language. A chunk of
texts asks for each of its distinct n-grams once, and gets a log-probability back for it. Counts are added
up, and questions answered, for a bounded number of chunks at a time: a shard of frequent n-grams is in no
task whole but as its model, whose distinct n-grams no longer grow with the input.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import CHUNK_SCHEMA, chunks, gaps, lean_memory, pack, unpack
from .common import Scratch, plan_bytes, spread

ORDER = 5
#: Models that are made at a time, as their byte pairs pass through the driver; more languages take more rounds.
MODELS = 64
#: Bytes of text whose n-grams are looked at together.
TILE = 1 << 18
#: Bytes of text in a chunk, which asks for each n-gram once.
CHUNK_BYTES = 8 << 20
#: Bytes of text for each shard of n-grams.
SHARD_BYTES = 32 << 20
#: Chunks whose counts of a shard one task adds up, and that it answers.
FAN, ASKING = 64, 512
#: One trusted row in HELD_OUT sets thresholds and trains nothing.
HELD_OUT = 5
#: Held-out rows that are enough to set a language's thresholds. With fewer, all its trusted rows do, each scored by a
#: model of the other folds'; a language with under LEAST trusted rows has no model.
ENOUGH, FOLDS, LEAST = 50, 5, 20
#: Shares of held-out rows outside the thresholds, the room beyond these (nats), and the bytes of average
#: text that every row is smoothed with, as short texts scatter.
TAILS, ROOM, SMOOTH = (0.002, 0.998), 0.1, 200
UNIT = 32  # steps of a nat in stored log-probabilities; a text's sum is rounded that finely at each byte
_LOW = [np.uint64((1 << 8 * k) - 1) for k in range(ORDER + 1)]
_LANG = ~_LOW[ORDER]


def held_out(ids: np.ndarray) -> np.ndarray:
    """Which ids are held out; the same in SQL by _held()."""
    return (ids // 20 % HELD_OUT) == 0


def _held(col):
    return F.pmod(F.floor(col / 20), F.lit(HELD_OUT)) == 0


def folds(ids: np.ndarray) -> np.ndarray:
    """The fold of each id; not by its place among ids, as a small language's ids may lie close together."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % FOLDS


def slots(languages: list[tuple[str, int, int]]) -> tuple[dict[bytes, int], np.ndarray]:
    """Of languages with their numbers of trusted and of held-out rows: the models' numbers, and how each is made.

    0: held-out rows set thresholds. 1: folds do; their models follow the language's own. 2: as 1, and held-out rows
    train too, being over half of all.
    """
    names, kinds = {}, []
    for name, n, held in languages:
        names[name.encode()] = len(kinds)
        kinds += [0] if held >= ENOUGH else [1 + (2 * held > n)] * (1 + FOLDS)
    return names, np.array(kinds, np.int64)


def rounds(languages: list[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """Languages in groups of at most MODELS models, or of one language."""
    out, used = [[]], 0
    for x in languages:
        n = len(slots([x])[1])
        if out[-1] and used + n > MODELS:
            out.append([])
            used = 0
        out[-1].append(x)
        used += n
    return out


def passes(ids, lengths, data, lang, trusted, kinds):
    """For the languages' models, then for each fold's: the texts, their models, which texts train, and their rows.

    Folds' models get trusted rows of their languages only.
    """
    kind = np.append(kinds, 0)[lang]
    every = np.arange(len(ids))
    yield data, lengths, lang, trusted & ((kind == 2) | ~held_out(ids)), every
    if (mine := trusted & (kind > 0)).any():
        part, rows = data[np.repeat(mine, lengths)], every[mine]
        for f in range(FOLDS):
            yield part, lengths[rows], lang[rows] + 1 + f, folds(ids[rows]) != f, rows


def key_tiles(data: np.ndarray, lengths: np.ndarray, lang: np.ndarray):
    """For tiles of the texts' bytes: the n-gram that ends at each byte, as language and five bytes, and its text.

    Texts start after line feeds. Those without a language (-1) are left out. A tile is bounded, whatever
    the length of a text.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    for a in range(0, len(data), TILE):
        b = min(a + TILE, len(data))
        doc = np.searchsorted(ends, np.arange(a, b), side="right")
        inside = np.arange(a, b) - starts[doc]
        near = np.concatenate((np.full(max(0, ORDER - 1 - a), 10, np.uint8), data[max(0, a - ORDER + 1) : b]))
        key = lang[doc].astype(np.uint64) << np.uint64(8 * ORDER)
        for back in range(ORDER):
            before = near[ORDER - 1 - back : ORDER - 1 - back + b - a]
            if back:
                before = np.where(inside >= back, before, np.uint8(10))
            key |= before.astype(np.uint64) << np.uint64(8 * back)
        use = lang[doc] >= 0
        yield (key, doc) if use.all() else (key[use], doc[use])


def suffix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & (_LANG | _LOW[n])


def _languages(raw_lengths: np.ndarray, raw: np.ndarray, names: dict[bytes, int]) -> np.ndarray:
    text, at, out = raw.tobytes(), 0, []
    for n in raw_lengths:
        out.append(names.get(text[at : at + n], -1))
        at += n
    return np.array(out, np.int64)


def _trusted(ids: np.ndarray, known: np.ndarray, table) -> np.ndarray:
    good = [x for x in table.column("good").to_pylist() if x is not None]
    return np.isin(ids, np.array(good[0], np.int64)) & (known > 0) if good else np.zeros(len(ids), bool)


def _by_shard(keys: np.ndarray, shards: int):
    """Of distinct keys in order, for each shard: its number and which keys are its own."""
    shard = (_spread(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        yield int(shard[order[x]]), order[x:y]


def _rows(ids, lengths, data, lang, trusted, kinds, shards: int, counts: bool):
    """Of a chunk, for each shard: its distinct n-grams; with counts, those of training rows and how often they are met."""
    found, times = [], []
    for texts, sizes, models, trains, _ in passes(ids, lengths, data, lang, trusted, kinds):
        if counts:  # texts that train nothing are left out at once
            texts, sizes, models = texts[np.repeat(trains, sizes)], sizes[trains], models[trains]
        for keys, _ in key_tiles(texts, sizes, models):
            k, n = np.unique(keys, return_counts=True)
            found.append(k)
            times.append(n)
    if not found:
        return []
    distinct, back = np.unique(np.concatenate(found), return_inverse=True)
    total = np.bincount(back, np.concatenate(times), minlength=len(distinct)).astype(np.uint32)
    return [(shard, pack(gaps(distinct[own]), total[own]) if counts else pack(gaps(distinct[own]))) for shard, own in _by_shard(distinct, shards)]


def _table(chunk: int, rows: list[tuple[int, bytes]]) -> dict:
    return {"shard": pa.array([x for x, _ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "value": pa.array([v for _, v in rows], pa.binary())}


def _counted(names: dict[bytes, int], kinds: np.ndarray, shards: int):
    def run(key, table):
        lean_memory()
        rows = []
        for blob in (b for b in table.column("blob").to_pylist() if b is not None):
            ids, known, lengths, data, a, b = unpack(blob)
            rows = _rows(ids, lengths, data, _languages(a, b, names), _trusted(ids, known, table), kinds, shards, True)
        return pa.table(_table(key[0].as_py(), rows))

    return run


def _asked(names: dict[bytes, int], kinds: np.ndarray, shards: int):
    """What chunks ask. Of languages with folds all rows ask the folds' models, as which are trusted is not known here."""

    def run(batches):
        lean_memory()
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                ids, known, lengths, data, a, b = unpack(blob)
                rows = _rows(ids, lengths, data, _languages(a, b, names), np.ones(len(ids), bool), kinds, shards, False)
                yield pa.RecordBatch.from_pydict(_table(chunk, rows))

    return run


def _spread(keys: np.ndarray) -> np.ndarray:
    """A hash of the language and the two last bytes of the context."""
    x = ((keys >> np.uint64(8 * ORDER)) << np.uint64(16)) | ((keys >> np.uint64(8)) & _LOW[2])
    x = (x ^ (x >> np.uint64(9))) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(32)


def adjusted(keys: np.ndarray, counts: np.ndarray):
    """Observed n-grams of orders ORDER to 3 with counts, for the lower ones the numbers of bytes seen before them."""
    seen = counts > 0
    g, a = keys[seen], counts[seen].astype(np.int64)
    out = {ORDER: (g, a)}
    for n in range(ORDER - 1, 2, -1):
        g, a = np.unique(suffix(g, n), return_counts=True)
        out[n] = (g, a)
    return out


def _fold(key, table):
    """Of some of a shard's counts: their sums."""
    lean_memory()
    parts = [unpack(v) for v in table.column("value").to_pylist()]
    keys, back = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
    return pa.table({"shard": [key[0].as_py()], "part": [key[1].as_py()], "value": pa.array([pack(gaps(keys), counts)], pa.binary())})


def _shared(batches):
    """What shards have to share: counts of counts (language, order, count up to 4), and bytes seen before each pair."""
    for batch in batches:
        for v in batch.column("value").to_pylist():
            keys, counts = unpack(v)
            levels = adjusted(np.cumsum(keys, dtype=np.uint64), counts)
            ks, ns = [], []
            for n, (g, a) in levels.items():
                few = a <= 4
                code = ((g[few] >> np.uint64(8 * ORDER)) << np.uint64(8)) | np.uint64(n << 4) | a[few].astype(np.uint64)
                k, c = np.unique(code, return_counts=True)
                ks.append(k.astype(np.int64))
                ns.append(c)
            k, c = np.unique(suffix(levels[3][0], 2), return_counts=True)
            ks.append(((k >> np.uint64(8 * ORDER)) << np.uint64(16) | (k & _LOW[2])).astype(np.int64) + (1 << 40))
            ns.append(c)
            yield pa.record_batch([pa.array(np.concatenate(ks)), pa.array(np.concatenate(ns).astype(np.int64))], names=["k", "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What modified Kneser-Ney takes off counts 0, 1, 2 and 3 or more; fixed values where counts of counts are missing."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *[min(max(x, 0.05), i) for i, x in enumerate(d, 1)]])


def _smoothed(a: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Rows of counts by context, smoothed with the lower order's probabilities."""
    d = discounts(*[int((a == i).sum()) for i in (1, 2, 3, 4)])
    total = a.sum(1, keepdims=True)
    off = d[np.minimum(a, 3)]
    return np.where(total > 0, (np.maximum(a - off, 0) + off.sum(1, keepdims=True) * lower) / np.maximum(total, 1), lower)


def low_orders(rows: list, languages: int):
    """From what shards share: probabilities of byte pairs (language, before, byte), discounts (language, order, count)."""
    pairs = np.zeros((languages, 256, 256), np.int64)
    few = np.zeros((languages, ORDER + 1, 5), np.int64)
    for k, n in rows:
        if k >= 1 << 40:
            k -= 1 << 40
            pairs[k >> 16, k >> 8 & 255, k & 255] = n
        else:
            few[k >> 8, k >> 4 & 15, k & 15] = n
    p2 = np.empty(pairs.shape, np.float32)
    for g in range(languages):
        p1 = _smoothed((pairs[g] > 0).sum(0, keepdims=True), np.full((1, 256), 1 / 256))
        p2[g] = _smoothed(pairs[g], p1)
    d = np.array([[discounts(*few[g, n, 1:]) for n in range(ORDER + 1)] for g in range(languages)])
    return p2, d


def probabilities(keys: np.ndarray, counts: np.ndarray, p2: np.ndarray, d: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """The model's probability of the last byte of each n-gram that is asked (keys, if none are given); counts: training
    counts of keys, which hold all n-grams that were seen with the asked ones' last two bytes of context."""
    asked = keys if asked is None else asked
    lang = (asked >> np.uint64(8 * ORDER)).astype(np.int64)
    p = p2[lang, (asked >> np.uint64(8) & np.uint64(255)).astype(np.int64), (asked & np.uint64(255)).astype(np.int64)].astype(np.float64)
    levels = adjusted(keys, counts)
    for n in range(3, ORDER + 1):
        g, a = levels[n]
        if not len(g):
            continue
        context = g >> np.uint64(8)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        off = d[(g >> np.uint64(8 * ORDER)).astype(np.int64), n, np.minimum(a, 3)]
        total, free = np.add.reduceat(a, first), np.add.reduceat(off, first)
        mine = suffix(asked, n)
        at = np.minimum(np.searchsorted(g, mine), len(g) - 1)
        kept = np.where(g[at] == mine, a[at] - off[at], 0.0)
        c = np.minimum(np.searchsorted(context[first], mine >> np.uint64(8)), len(first) - 1)
        known = context[first][c] == mine >> np.uint64(8)
        p = np.where(known, (np.maximum(kept, 0) + free[c] * p) / total[c], p)
    return p


def _answer(p2: np.ndarray, d: np.ndarray):
    """Of a shard's model and what some chunks ask of it: to each chunk the costs of its n-grams."""

    def run(key, table):
        lean_memory()
        owners, values = table.column("chunk").to_pylist(), [unpack(v) for v in table.column("value").to_pylist()]
        model = [v for o, v in zip(owners, values, strict=True) if o is None]
        keys, counts = (np.cumsum(model[0][0], dtype=np.uint64), model[0][1]) if model else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        asking = [(o, np.cumsum(v[0], dtype=np.uint64)) for o, v in zip(owners, values, strict=True) if o is not None]
        out = []
        if asking:
            asked, back = np.unique(np.concatenate([x for _, x in asking]), return_inverse=True)
            cost = np.minimum(np.round(-np.log(probabilities(keys, counts, p2, d, asked)) * UNIT), 65535).astype(np.uint16)[back]
            at = 0
            for o, x in asking:
                out.append((o, pack(gaps(x), cost[at : at + len(x)])))
                at += len(x)
        return pa.table({"chunk": pa.array([o for o, _ in out], pa.int64()), "value": pa.array([v for _, v in out], pa.binary())})

    return run


def _score(names: dict[bytes, int], kinds: np.ndarray):
    order = {i: g.decode() for g, i in names.items()}

    def run(key, table):
        lean_memory()
        values = [unpack(v) for v in table.column("value").to_pylist() if v is not None]
        ids, known, lengths, data, a, b = unpack(next(x for x in table.column("blob").to_pylist() if x is not None))
        lang = _languages(a, b, names)
        total, unseen = np.zeros(len(ids)), np.full(len(ids), np.nan)
        trusted, use = _trusted(ids, known, table), lang >= 0
        if values and use.any():
            asked = np.concatenate([np.cumsum(v[0], dtype=np.uint64) for v in values])
            cost = np.concatenate([v[1] for v in values])
            o = np.argsort(asked)
            asked, cost = asked[o], cost[o]
            for texts, sizes, models, trains, rows in passes(ids, lengths, data, lang, trusted, kinds):
                sums = np.zeros(len(sizes))
                for keys, doc in key_tiles(texts, sizes, models):
                    if len(doc):
                        part = np.bincount(doc - doc[0], cost[np.searchsorted(asked, keys)])
                        sums[doc[0] : doc[0] + len(part)] += part / UNIT
                if texts is data:
                    total = sums
                    unseen = np.where(trusted & use & held_out(ids) & (kinds[lang] == 0), total, np.nan)
                else:
                    unseen[rows[~trains]] = sums[~trains]
        return pa.table({
            "doc_id": pa.array([int(i) if k else None for i, k in zip(ids, known, strict=True)], pa.int64()),
            "model": pa.array([order.get(int(g)) for g in lang], pa.string()),
            "n_bytes": pa.array(lengths, pa.int64()),
            "nll": pa.array(total, pa.float64()),
            "unseen": pa.array(unseen, pa.float64(), mask=np.isnan(unseen)),
        })

    return run


def _scored(scratch: Scratch, given: DataFrame, good: DataFrame, languages: list[tuple[str, int, int]], shards: int) -> DataFrame:
    """doc_id, model, n_bytes, nll, and unseen (nll by a model that did not see the row, of rows that set thresholds)."""
    names, kinds = slots(languages)
    stored = scratch.table(spread(given).mapInArrow(chunks(True, CHUNK_BYTES), CHUNK_SCHEMA), "chunks", "uncompressed")
    trusted = stored.select("chunk", F.explode("ids").alias("doc_id")).join(good, "doc_id", "left_semi").groupBy("chunk").agg(F.collect_list("doc_id").alias("good"))
    trusted = scratch.table(trusted, "trusted")
    blobs = stored.select("chunk", "blob", F.lit(None).cast("array<bigint>").alias("good"))
    work = blobs.unionByName(trusted.select("chunk", F.lit(None).cast("binary").alias("blob"), "good"))
    n = stored.count()

    def part(of: str, most: int, n: int):
        return F.pmod(F.xxhash64(of), F.lit(-(-n // most))).cast("long").alias("part")

    # counts are added up FAN at a time, so that no task holds all chunks' counts of a shard, however frequent its n-grams
    counts = work.groupBy("chunk").applyInArrow(_counted(names, kinds, shards), "shard long, chunk long, value binary").select("shard", part("chunk", FAN, max(1, n)), "value")
    left = max(1, -(-n // FAN))
    while True:
        counts = counts.groupBy("shard", "part").applyInArrow(_fold, "shard long, part long, value binary")
        if left == 1:
            break
        counts = counts.select("shard", part("part", FAN, left), "value")
        left = -(-left // FAN)
    model = scratch.table(counts.select("shard", "value"), "model", "uncompressed")
    # at most 65 536 pairs and 20 counts of counts a language, of MODELS models at most
    shared = model.mapInArrow(_shared, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    p2, d = low_orders([(r["k"], r["n"]) for r in shared.collect()], len(kinds))
    # a shard answers ASKING chunks in a task, and as many tasks get its model as its chunks need
    asked = stored.select("chunk", "blob").mapInArrow(_asked(names, kinds, shards), "shard long, chunk long, value binary")
    asked = asked.select("shard", part("chunk", ASKING, max(1, n)), "chunk", "value")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n // ASKING)) - 1).cast("long")))
    told = model.select("shard", everywhere.alias("part"), F.lit(None).cast("long").alias("chunk"), "value")
    answers = asked.unionByName(told).groupBy("shard", "part").applyInArrow(_answer(p2, d), "chunk long, value binary")
    again = work.withColumn("value", F.lit(None).cast("binary")).unionByName(answers, allowMissingColumns=True)
    out = scratch.table(again.groupBy("chunk").applyInArrow(_score(names, kinds), "doc_id long, model string, n_bytes long, nll double, unseen double"), "scored")
    scratch.drop(model)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, model, n_bytes, nll, perplexity, score, low, high, keep for each row.

    Trusted rows are those that labels mark quality 1 and toxic 0. nll is the negative log-likelihood of
    all the text's bytes; perplexity exp(nll / n_bytes); score the smoothed nll of a byte, which must lie
    between the language's quantiles of trusted rows, by scores of models that did not see these: of held-out
    rows, or (with under ENOUGH held out) of all trusted rows, each by a model of the other folds' rows.
    Counts cover all trusted rows and grow with the input. However many languages there are, all with LEAST
    trusted ids get a model; beyond MODELS models these are made in rounds, each over its languages' rows.

    Null or empty text, and rows of a language with under LEAST trusted ids with text, have no score and are
    kept: nothing speaks against them, and so few rows give no quantile. A null language counts as a language.
    Several labels of an id: each counts as one. Null ids are scored as others. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "perplexity")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    own = given.where("length(text) > 0").select("doc_id", "lang").join(good, "doc_id", "left_semi").distinct()
    counts = own.groupBy("lang").agg(F.count("*").alias("n"), F.sum(_held(F.col("doc_id")).cast("long")).alias("held")).where(F.col("n") >= LEAST)
    groups = rounds([tuple(r) for r in counts.orderBy(F.desc("n"), "lang").collect()])
    shards = int(max(12, 3 * plan_bytes(docs) // SHARD_BYTES))
    if len(groups) > 1:  # one row for each language; languages without a model go with the first group
        number = spark.createDataFrame([(x[0], i) for i, group in enumerate(groups) for x in group], "lang string, round int")
        given = given.join(F.broadcast(number), "lang", "left").withColumn("round", F.coalesce("round", F.lit(0)))
    parts = [_scored(scratch, given.where(F.col("round") == i).drop("round") if len(groups) > 1 else given, good, group, shards) for i, group in enumerate(groups)]
    scored = reduce(DataFrame.unionByName, parts)

    smooth = lambda nll: (F.col(nll) + SMOOTH * F.col("mean")) / (F.col("n_bytes") + SMOOTH)
    # means and limits have a row for each language that has a model
    sample = scored.where("unseen is not null and n_bytes > 0")
    means = sample.groupBy("model").agg((F.sum("unseen") / F.sum("n_bytes")).alias("mean"))
    limits = sample.join(F.broadcast(means), "model").withColumn("score", smooth("unseen")).groupBy("model").agg(F.percentile_approx("score", list(TAILS), 100_000).alias("q"), F.first("mean").alias("mean"))
    limits = scratch.table(limits.select("model", "mean", (F.col("q")[0] - ROOM).alias("low"), (F.col("q")[1] + ROOM).alias("high")), "limits")
    out = scored.join(F.broadcast(limits), "model", "left")  # a row for each language that has a model
    told = (F.col("n_bytes") > 0) & F.col("mean").isNotNull()
    score = F.when(told, smooth("nll"))
    return out.select(
        "doc_id",
        "model",
        "n_bytes",
        "nll",
        F.when(told, F.exp(F.col("nll") / F.col("n_bytes"))).alias("perplexity"),
        score.alias("score"),
        "low",
        "high",
        F.coalesce(score.between(F.col("low"), F.col("high")), F.lit(True)).alias("keep"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it stays."""
    out = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumns({c: F.round(c, 6) for c in ("nll", "perplexity", "score", "low", "high")})


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
