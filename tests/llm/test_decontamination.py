import random

from pyspark.sql import types as T

from strandloom.llm.decontamination import ERROR_RATE, Finder, contaminated, distances, masks, normal, pieces, places

from .cases import EDGES, documents, text


def table(pattern: bytes, data: bytes, free: bool) -> list[int]:
    last = [0] * (len(data) + 1) if free else list(range(len(data) + 1))
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, x in enumerate(data, 1):
            now.append(min(last[j - 1] + (c != x), last[j] + 1, now[-1] + 1))
        last = now
    return last[1:]


def test_distances_against_the_whole_table():
    rng = random.Random(1)
    for _ in range(300):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 150)))
        for free in (True, False):
            assert list(distances(len(p), masks(p), t, free)) == table(p, t, free)


def test_pieces_make_up_the_item():
    for n in (1, 5, 13, 80, 399):
        item = bytes(i % 251 for i in range(n))
        budget, parts = pieces(item, ERROR_RATE)
        assert len(parts) == budget + 1 and b"".join(p for _, p in parts) == item and all(item[a : a + len(p)] == p for a, p in parts)


def test_normal_and_places():
    t = "  Ärger,   it's A Test! \n"
    assert normal(t).decode() == "ärger it s a test"
    at = places(t)
    assert len(at) == len(normal(t)) and t[at[0]] == "Ä" and t[at[-1]] == "t"


def damaged(rng, s: str, edits: int) -> str:
    s = list(s)
    for _ in range(edits):
        k = rng.randrange(1, len(s) - 1)
        rng.choice([lambda: s.__setitem__(k, "q"), lambda: s.insert(k, "q"), lambda: s.pop(k)])()
    return "".join(s)


def test_found_is_what_brute_force_finds(spark):
    rng = random.Random(2)
    items = [(i, text(rng.randint(8, 40), 500 + i)) for i in range(12)] + [(90, ""), (91, None), (92, "!?")]
    rows = [r for r in EDGES if r[0] not in (6, 7)]
    for i in range(60):
        _, item = items[i % 12]
        body = damaged(rng, item, int(len(item) * rng.choice([0, 0.03, 0.07, 0.12, 0.2])))
        rows.append((100 + i, f"{text(10, i)} {body.upper() if i % 3 else body}. {text(5, i + 7)}", "en", "a", 1))
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    bench = spark.createDataFrame(items, schema)
    for block in (1 << 20, 300):  # one pass, and several
        got = contaminated(documents(spark, rows), bench, block_bytes=block).collect()
        best = {}
        for r in got:
            best[r["doc_id"], r["item_id"]] = min(r["distance"], best.get((r["doc_id"], r["item_id"]), 999))
        want = {}
        for r in rows:
            for n, item in items:
                p, t = normal(item or ""), normal(r[1] or "")
                if p and t and (d := min(table(p, t, True))) <= int(len(p) * ERROR_RATE):
                    want[r[0], n] = d
        assert best == want and len(want) > 25


def test_places_of_an_exact_copy(spark):
    item = text(20, 77)
    doc = f"Before: {item} -- after. {item.title()}!"
    got = contaminated(documents(spark, [(1, doc, "en", "a", 1)]), spark.createDataFrame([(5, item)], "item_id long, text string")).orderBy("start").collect()
    assert [(r["distance"], doc[r["start"] : r["end"]].lower()) for r in got] == [(0, item), (0, item)]


def test_empty(spark):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert contaminated(documents(spark, []), bench).collect() == []
    assert contaminated(documents(spark), bench.where("false")).collect() == []


def test_one_item_inside_another():
    long = normal(text(30, 5))
    short = long[40:100]
    f = Finder([(1, long), (2, short)], 0.08)
    found = f.find(b"x " + long + b" y")
    assert {(n, d) for n, d, _, _ in found} == {(0, 0), (1, 0)}
