"""Removal of passages that an earlier document has, by a sampled suffix array.

Suffixes start at tokens that the text itself picks: of each `span`-byte string the least of its hashed
grams, the leftmost if several. Equal strings pick equal tokens, so every repeated string is found at a
token both times, while about one byte in fourteen starts a token. Tokens whose gram no second document
has are dropped first, by hashes alone. The suffixes that are left, with the bytes before them that a
string may reach back to, are range-partitioned by sampled splitters over the leading gram; every bucket
sorts by multikey quicksort on eight-byte symbols and compares its strings. Bucket bounds never split a
gram, so strings on the two sides of a bound differ. A gram of many documents is dealt by its whole
strings instead: a chunk asks once for each of these, with its least document, and is told the least of all,
so occurrences of a frequent string never meet in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import CHUNK_SCHEMA, chunks, gaps, lean_memory, pack, unpack
from .common import Scratch, plan_bytes, spread
from .shingles import mix

GRAM = 24
#: Bytes of text in a chunk, and that are hashed at once.
CHUNK_BYTES, TILE = 2 << 20, 1 << 18
#: Bits of a gram's hash that decide; the rest of a word holds the place within a tile.
PLACE = 21
#: Distinct grams in a bucket of hashes, and contexts in a bucket of suffixes, on average.
BUCKET_GRAMS, BUCKET_SUFFIXES = 1_000_000, 100_000
#: Grams that splitters are taken from, at most about.
SAMPLE = 100_000
#: Rows that are sorted without parting them first.
SMALL = 4096
#: Documents of one gram beyond which its strings are dealt out one by one, and tokens of these that are looked at together.
HOT, HOT_TOKENS = 4096, 20_000

_rng = np.random.default_rng(99)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of each GRAM bytes of a tile."""
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(TILE + 256, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    n = len(data)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers[0][:n], out=c[1:])
    return mix((c[GRAM:] - c[:-GRAM]) * _powers[1][: n - GRAM + 1])


def even(h: np.ndarray) -> np.ndarray:
    """A bijection of the hashes that decide. As the least ones are chosen they are small; spread out, ranges of them are alike."""
    most = np.uint64((1 << 64 - PLACE) - 1)
    h = h * np.uint64(0x9E3779B97F4A7C15) & most
    h = (h ^ (h >> np.uint64(22))) * np.uint64(0xD1342543DE82EF95) & most
    return h ^ (h >> np.uint64(22))


def tokens(data: np.ndarray, bounds: np.ndarray, span: int):
    """Place, first and last owned string, and hash of each token of a chunk; bounds: the ends of its documents."""
    width = span - GRAM + 1
    step = TILE - span
    found = []
    for a in range(0, len(data) - span + 1, step):
        tile = data[a : a + TILE]
        if len(tile) < span:
            break
        h = gram_hashes(tile)
        key = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[: size - width], key[width - size :])
        key = key[: min(step, len(key))]
        at = np.arange(a, a + len(key))
        inside = np.searchsorted(bounds, at, side="right") == np.searchsorted(bounds, at + span - 1, side="right")
        key, at = key[inside], at[inside]
        if len(key):
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            found.append((a + (key[new] & np.uint64((1 << PLACE) - 1)).astype(np.int64), at[new], at[np.append(new[1:], len(key)) - 1], key[new] >> np.uint64(PLACE)))
    if not found:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    p, lo, hi, h = [np.concatenate(x) for x in zip(*found, strict=True)]
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))  # a token may be met from two tiles
    return p[first], lo[first], hi[np.append(first[1:], len(p)) - 1], even(h[first])


def symbols(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of eight-byte symbols that compare alike."""
    n, m = rows.shape
    wide = np.zeros((n, -(-m // 8) * 8), np.uint8)
    wide[:, :m] = rows
    return wide.view(">u8").astype(np.uint64)


def _by_symbols(rows: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """A few rows in order from symbol k on: sorted by one symbol, then those that tie by the next."""
    own = own[np.argsort(rows[own, k], kind="stable")]
    s = rows[own, k]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    for j in range(k + 1, rows.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part = np.cumsum(new)[where]
        some = own[where]
        sub = np.lexsort((rows[some, j], part))
        own[where] = some[sub]
        s, q = rows[own[where], j], part[sub]
        new[where] |= np.concatenate(([True], (s[1:] != s[:-1]) | (q[1:] != q[:-1])))
    return own


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of symbols, and a flag where a row differs from the one before it; equal rows keep their order.

    Multikey quicksort: rows are parted three ways by one symbol, under, at and over a pivot; those at the pivot go on
    to the next symbol. Parts of SMALL rows at most are sorted at once.
    """
    n, width = rows.shape
    order = np.arange(n)
    todo = [(0, n, 0)] if n else []
    while todo:
        a, b, k = todo.pop()
        own = order[a:b]
        if b - a <= SMALL:
            order[a:b] = _by_symbols(rows, own, k)
            continue
        s = rows[own, k]
        pivot = np.sort(s[:: len(s) // 63])[32]
        under, over = s < pivot, s > pivot
        low, high = a + int(under.sum()), b - int(over.sum())
        order[a:b] = np.concatenate((own[under], own[~(under | over)], own[over]))
        todo += [(x, y, j) for x, y, j in ((a, low, k), (low, high, k + 1), (high, b, k)) if y - x > 1 and j < width]
    done = rows[order]
    return order, np.concatenate((np.ones(min(n, 1), bool), (done[1:] != done[:-1]).any(1)))


def least_of(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row a number that equal rows share, and the least document of equal rows."""
    order, new = multikey_sort(symbols(rows))
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.minimum.reduceat(docs[order], np.flatnonzero(new))[group]


def _hashes(span: int, buckets: int, rate: int):
    """Each chunk's distinct grams by range of hash, with the number of its documents, and sampled grams."""

    def run(batches):
        lean_memory()
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                ids, known, lengths, data = unpack(blob)
                bounds = np.cumsum(lengths)
                p, _, _, h = tokens(data, bounds, span)
                use = known[np.searchsorted(bounds, p, side="right")] > 0 if len(p) else np.zeros(0, bool)
                p, h = p[use], h[use]
                if not len(p):
                    continue
                order = np.argsort(h, kind="stable")
                doc = np.searchsorted(bounds, p, side="right")[order]
                s = h[order]
                new = np.concatenate(([True], s[1:] != s[:-1]))
                fresh = new | np.concatenate(([True], doc[1:] != doc[:-1]))
                starts = np.flatnonzero(new)
                grams, first = s[starts], p[order[starts]]
                n_docs = np.add.reduceat(fresh.astype(np.int64), starts).astype(np.uint32)
                bucket = ((grams >> np.uint64(11)) * np.uint64(buckets) >> np.uint64(53 - PLACE)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets + 1))
                rows = []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    g = grams[a:b]
                    pick = np.flatnonzero(mix(g) % np.uint64(rate) == 0)
                    text = np.lib.stride_tricks.sliding_window_view(data, GRAM)[first[a:b][pick]]
                    rows.append((int(bucket[a]), chunk, pack(gaps(g), n_docs[a:b], pick.astype(np.int64), text)))
                if rows:
                    yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "chunk", "value"])

    return run


def _shared(hot: int):
    """Of a range of hashes: to each chunk those of its grams that two documents have, and how many grams these are."""

    def run(key, table):
        lean_memory()
        owners = table.column("chunk").to_pylist()
        parts = [unpack(v) for v in table.column("value").to_pylist()]
        grams = [np.cumsum(x[0], dtype=np.uint64) for x in parts]
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        s = every[order]
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        count = np.add.reduceat(np.concatenate([x[1] for x in parts]).astype(np.int64)[order], starts)
        total = np.empty(len(s), np.int64)
        total[order] = np.repeat(count, np.diff(np.append(starts, len(s))))
        out, at = [], 0
        for chunk, g, (_, _, pick, text) in zip(owners, grams, parts, strict=True):
            own = total[at : at + len(g)]
            at += len(g)
            if (keep := own > 1).any():
                sample = text[keep[pick]]
                is_hot = own[keep] > hot
                out.append((chunk, int(keep.sum()), bool(is_hot.any()), pack(gaps(g[keep]), is_hot.astype(np.uint8)), sample.tobytes()))
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(("chunk", "n", "hot", "value", "sample"), types, strict=True))})

    return run


def hot_strings(data: np.ndarray, span: int, buckets: int, lo: np.ndarray, hi: np.ndarray, who: np.ndarray):
    """All strings that tokens of frequent grams own: part, bucket, distinct strings, and of each occurrence the string's
    number, its place and its document. The same for the same chunk, whenever it is asked for."""
    for part, a in enumerate(range(0, len(lo), HOT_TOKENS)):
        low, high = lo[a : a + HOT_TOKENS], hi[a : a + HOT_TOKENS]
        n = high - low + 1
        start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(who[a : a + HOT_TOKENS], n)
        rows = np.lib.stride_tricks.sliding_window_view(data, span)[start]
        mixed = np.zeros(len(rows), np.uint64)
        for s in symbols(rows).T:
            mixed = mix(mixed + s)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            some = order[x:y]
            o, new = multikey_sort(symbols(rows[some]))
            member = np.empty(len(some), np.int64)
            member[o] = np.cumsum(new) - 1
            yield part, int(bucket[some[0]]), rows[some][o[new]], member, start[some], own[some]


def _shared_tokens(data: np.ndarray, bounds: np.ndarray, known: np.ndarray, span: int, grams: np.ndarray):
    """Tokens of known documents whose grams are among grams (in order): place, first and last owned string, document, and the gram's number."""
    p, lo, hi, h = tokens(data, bounds, span)
    at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
    doc = np.searchsorted(bounds, p, side="right")
    keep = (grams[at] == h) & (known[np.minimum(doc, len(known) - 1)] > 0)
    return p[keep], lo[keep], hi[keep], doc[keep], at[keep]


def _suffixes(span: int, splitters: list[bytes], hot_buckets: int):
    """Each chunk's shared tokens as suffixes for the buckets; equal ones of a chunk share their bytes."""
    back = span - GRAM
    cuts = symbols(np.frombuffer(b"".join(splitters), np.uint8).reshape(-1, GRAM))

    def run(key, table):
        lean_memory()
        kinds, values = table.column("kind").to_pylist(), table.column("value").to_pylist()
        ids, known, lengths, data = unpack(values[kinds.index(0)])
        replies = [unpack(v) for k, v in zip(kinds, values, strict=True) if k == 1]
        out = []
        if replies:
            grams = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in replies])
            is_hot = np.concatenate([r[1] for r in replies]) > 0
            order = np.argsort(grams)
            grams, is_hot = grams[order], is_hot[order]
            bounds = np.cumsum(lengths)
            p, lo, hi, doc, at = _shared_tokens(data, bounds, known, span, grams)
            hot, ids_of = is_hot[at], ids[doc]
            views = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(back, np.uint8), data, np.zeros(span, np.uint8))), back + span)

            def sent(kind, bucket, rows, lens, who, where):
                order = np.argsort(bucket, kind="stable")
                cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    own = order[a:b]
                    both = np.concatenate((rows[own], lens[own]), axis=1)
                    o, new = multikey_sort(symbols(both))
                    number = np.cumsum(new) - 1
                    back_ = np.empty(len(own), np.int64)
                    back_[o] = number
                    by = np.argsort(where[own], kind="stable")
                    out.append((f"{kind}{bucket[own[0]]}", key[0].as_py(), pack(both[o[new]], back_[by].astype(np.uint32), gaps(where[own][by]), who[own][by])))

            cold = np.flatnonzero(~hot)
            for a in range(0, len(cold), 100_000):
                c = cold[a : a + 100_000]
                near = views[p[c]]
                rows = np.concatenate((near[:, back:], near[:, :back][:, ::-1]), axis=1)
                lens = np.stack((p[c] - lo[c], p[c] - hi[c]), axis=1).astype(np.uint8)  # the owned strings start so far back, 176 at most
                lead = symbols(rows[:, :GRAM])
                bucket = np.searchsorted(cuts[:, 0], lead[:, 0])
                tied = np.flatnonzero(np.searchsorted(cuts[:, 0], lead[:, 0], side="right") > bucket)
                for k in np.unique(cuts[np.isin(cuts[:, 0], lead[tied, 0])], axis=0):
                    x = lead[tied]
                    bucket[tied] += (x[:, 0] == k[0]) & ((x[:, 1] > k[1]) | ((x[:, 1] == k[1]) & (x[:, 2] >= k[2])))
                sent("s", bucket, rows, lens, ids_of[c], p[c])
            for part, bucket, rows, member, _, who in hot_strings(data, span, hot_buckets, lo[hot], hi[hot], ids_of[hot]):
                first = np.full(len(rows), np.iinfo(np.int64).max)
                np.minimum.at(first, member, who)
                out.append((f"w{bucket}", key[0].as_py(), pack(np.array([part, bucket]), rows, first)))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.string()), "chunk": pa.array([x[1] for x in out], pa.int64()), "value": pa.array([x[2] for x in out], pa.binary())})

    return run


def _tell_least(names: list, parts: list) -> pa.Table:
    """Of strings of frequent grams, a chunk's once: to each chunk the least document of each."""
    rows = np.concatenate([x[1] for x in parts])
    _, least = least_of(rows, np.concatenate([x[2] for x in parts]))
    ends = np.cumsum([len(x[1]) for x in parts])
    out = [pack(x[0], least[e - len(x[1]) : e]) for x, e in zip(parts, ends, strict=True)]
    return pa.table({"chunk": pa.array(names, pa.int64()), "kind": pa.array([3] * len(out), pa.int32()), "value": pa.array(out, pa.binary())})


def _compare(span: int):
    """Of a bucket: the strings of each chunk that a document of a smaller id has, as places and lengths."""
    back = span - GRAM

    def run(key, table):
        lean_memory()
        names = table.column("chunk").to_pylist()
        parts = [unpack(v) for v in table.column("value").to_pylist()]
        if key[0].as_py()[0] == "w":
            return _tell_least(names, parts)
        rows = np.concatenate([x[0] for x in parts])
        shift = np.cumsum([0, *[len(x[0]) for x in parts[:-1]]])
        member = np.concatenate([x[1].astype(np.int64) + s for x, s in zip(parts, shift, strict=True)])
        where = np.concatenate([np.cumsum(x[2]) for x in parts])
        who = np.concatenate([x[3] for x in parts])
        owner = np.repeat(np.arange(len(parts)), [len(x[1]) for x in parts])
        first = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(first, member, who)
        group, least = least_of(rows, first)
        later = who > least[member]
        far, near = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
        longest, nearest = far[member], near[member]
        found = [(owner[later], (where - longest)[later], (longest - nearest)[later] + span)]
        # of the first document of each distinct context, single strings may have an earlier one
        order, new = multikey_sort(symbols(rows[:, :GRAM]))
        gram = np.empty(len(rows), np.int64)
        gram[order] = np.cumsum(new) - 1
        reps = np.flatnonzero(np.concatenate(([True], np.diff(np.sort(group)) > 0)))
        rep = np.argsort(group, kind="stable")[reps]
        many = np.bincount(gram[rep], minlength=gram.max() + 1) > 1
        rep = rep[many[gram[rep]]]
        if len(rep):
            text = np.concatenate((rows[:, span : span + back][:, ::-1], rows[:, :span]), axis=1)
            slot = np.full(len(rows), -1)
            slot[group[rep]] = np.arange(len(rep))
            has = np.zeros((len(rep), back + 1), bool)
            for j in range(back + 1):
                own = np.flatnonzero((far[rep] >= j) & (near[rep] <= j))
                if len(own) > 1:
                    _, early = least_of(text[rep[own], back - j : back - j + span], least[rep[own]])
                    has[own, j] = early < least[rep[own]]
            mine = np.flatnonzero(~later & (slot[group[member]] >= 0))
            mine = mine[has[slot[group[member[mine]]]].any(1)]
            for j in range(back + 1):
                # a run of strings j, j + 1, ... that ends here
                h = has[slot[group[member[mine]]]]
                end = h[:, j] & ~(h[:, j + 1] if j < back else np.zeros(len(mine), bool))
                own = mine[end]
                run_ = np.zeros(len(own), np.int64)
                alive = np.ones(len(own), bool)
                for i in range(j, -1, -1):
                    alive &= h[end, i]
                    run_ += alive
                found.append((owner[own], where[own] - j, run_ - 1 + span))
        c, start, size = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.lexsort((start, c))
        c, start, size = c[order], start[order], size[order]
        cut = np.append(np.flatnonzero(np.diff(c, prepend=-1)), len(c))
        out = [(names[c[a]], pack(gaps(start[a:b]), size[a:b].astype(np.uint16))) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([1] * len(out), pa.int32()), "value": pa.array([x[1] for x in out], pa.binary())})

    return run


def _remove(span: int, hot_buckets: int, with_text: bool):
    """Of a chunk: each document without the bytes that were found."""

    def run(key, table):
        lean_memory()
        kinds, values = table.column("kind").to_pylist(), table.column("value").to_pylist()
        ids, known, lengths, data = unpack(values[kinds.index(0)])
        mark = np.zeros(len(data) + 1, np.int32)
        for k, v in zip(kinds, values, strict=True):
            if k == 1:
                start, size = unpack(v)
                start = np.cumsum(start)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + size, -1)
        ends = np.cumsum(lengths)
        told = {tuple(x[0].tolist()): x[1] for x in (unpack(v) for k, v in zip(kinds, values, strict=True) if k == 3)}
        if told:  # strings of frequent grams, made again, with what their buckets say
            shared = [unpack(v) for k, v in zip(kinds, values, strict=True) if k == 2]
            grams = np.sort(np.concatenate([np.cumsum(x[0], dtype=np.uint64)[x[1] > 0] for x in shared]))
            _, lo, hi, doc, _ = _shared_tokens(data, ends, known, span, grams)
            for part, bucket, _, member, start, who in hot_strings(data, span, hot_buckets, lo, hi, ids[doc]):
                start = start[who > told[part, bucket][member]]
                np.add.at(mark, start, 1)
                np.add.at(mark, start + span, -1)
        gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
        out = []
        for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
            g = gone[a:b]
            kept = data[a:b][~g].tobytes() if g.any() else data[a:b].tobytes()
            runs = int((g[1:] & ~g[:-1]).sum() + g[0]) if b > a else 0
            out.append((int(ids[i]) if known[i] else None, int(b - a), int(g.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        made = {n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)}
        return pa.table(made if with_text else {n: made[n] for n in names[:-1]})

    return run


def remove_repeats(docs: DataFrame, span: int = 50, with_text: bool = False, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for each row.

    Removes each byte that a `span`-byte string covers which also starts in a row of a smaller id. Strings
    are judged on the input and never cross rows. span: 26 to 200. Null text is empty. Rows of equal ids
    remove nothing from each other; a row with null id loses nothing and counts for no other row. Other
    columns are ignored. An empty table gives an empty result. hot: documents of one gram beyond which its
    strings are dealt out one by one.
    """
    if not GRAM + 2 <= span <= 200:
        raise ValueError("span must be 26 to 200")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    given = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    stored = scratch.table(given.mapInArrow(chunks(most=CHUNK_BYTES), CHUNK_SCHEMA).drop("ids"), "chunks", "uncompressed")
    size = 3 * plan_bytes(docs)
    grams = size * 2 // (span - GRAM + 2)
    buckets = int(max(12, grams // BUCKET_GRAMS))
    rate = int(max(1, grams // SAMPLE))
    hashes = stored.mapInArrow(_hashes(span, buckets, rate), "bucket long, chunk long, value binary")
    shared = scratch.table(hashes.groupBy("bucket").applyInArrow(_shared(hot), "chunk long, n long, hot boolean, value binary, sample binary"), "shared", "uncompressed")
    found = shared.agg(F.sum("n")).first()[0] or 0
    # bounded: about SAMPLE grams of all chunks, fewer as only shared ones are kept
    sample = [s[i : i + GRAM] for (s,) in shared.where("length(sample) > 0").select("sample").collect() for i in range(0, len(s), GRAM)]
    sample.sort()
    parts = int(max(64, found // BUCKET_SUFFIXES))
    splitters = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    blobs = stored.select("chunk", F.lit(0).alias("kind"), F.col("blob").alias("value"))
    asked = blobs.unionByName(shared.select("chunk", F.lit(1).alias("kind"), "value"))
    suffixes = asked.groupBy("chunk").applyInArrow(_suffixes(span, splitters, parts), "bucket string, chunk long, value binary")
    spans = scratch.table(suffixes.groupBy("bucket").applyInArrow(_compare(span), "chunk long, kind int, value binary"), "spans", "uncompressed")
    frequent = scratch.table(shared.where("hot").select("chunk", F.lit(2).alias("kind"), "value"), "frequent", "uncompressed")
    scratch.drop(shared)
    work = blobs.unionByName(spans).unionByName(frequent)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return work.groupBy("chunk").applyInArrow(_remove(span, parts, with_text), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a 50-byte string of an earlier document covers."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), span=50)


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL = {
    "op9_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) b, strlen(coalesce(text, '')) n FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) f FROM w GROUP BY s),
h AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE f < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END fresh FROM h),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) k FROM g),
x AS (SELECT doc_id, k, min(i) a, max(i) + 49 z FROM r GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 a, a - 1 z FROM x UNION ALL SELECT doc_id, max(z) + 1, 1000000000 FROM x GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(hex(b[a:z]), '' ORDER BY a) t FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a + 1) c, count(*) s FROM x GROUP BY doc_id)
SELECT doc_id, n n_bytes, CAST(coalesce(c, 0) AS BIGINT) n_removed, coalesce(s, 0) n_spans, sha256(CASE WHEN t IS NULL THEN b ELSE unhex(t) END) kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
