"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

DataFrame functions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, prefix_sums, running, spread

# The patterns of the base kinds. Those in FAST match the same spans, as a run of a class
# is entered at its start only and is not given back, so that their work stays near the text's length.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
}
BASE = ("email", "ip", "card", "phone")
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
# Words that raise a span's score when they stand within CONTEXT characters before it.
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social security", "tax id"),
}
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT, BONUS, LEAST = 40, 0.3, 0.5
#: Matches before a span that reach over its context: none is shorter than two characters.
NEAR = CONTEXT // 2


def digits_of(match: Column) -> Column:
    return F.translate(match, " -().+", "")


def luhn(digits: Column) -> Column:
    """True if the sum of digits, each second one from the right doubled, is a multiple of ten."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def mod97(match: Column) -> Column:
    """True if country and check digits, moved behind the rest and read with A as 10, leave 1 by 97."""
    moved = F.concat(F.substr(match, F.lit(5)), F.substring(match, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    letters = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1)))
    return F.aggregate(letters, F.lit(0), lambda acc, c: (acc * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        d = digits_of(match)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    return mod97(match) if kind == "iban" else F.lit(True)


def found(kind: str, text: Column, size=F.length) -> Column:
    """Spans of a kind: kind, start, end (by size: code points, or bytes with octet_length), score, in order of start.

    Work is near the text's length, however many spans it has: starts are sums of what stands between matches, and a
    span's context is put together from the tails of the NEAR pieces before it.
    """
    pattern = FAST.get(kind, PATTERNS[kind])

    def scored(m: Column) -> Column:
        helped = reduce(lambda a, w: a | m["near"].contains(w), WORDS[kind], F.lit(False))
        score = F.lit(SCORES[kind]) + F.when(helped, BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + size(m["hit"])).cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    def tail(c: Column) -> Column:
        return F.substring(c, -CONTEXT, CONTEXT)

    def spans_in(both: Column) -> Column:
        ends = prefix_sums(F.transform(both, lambda z: (size(z["gap"]) + size(z["hit"])).cast("long")))

        def placed(tails: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                before = F.array_join(F.slice(tails, F.greatest(i - NEAR + 1, F.lit(1)), F.least(i, F.lit(NEAR))), "")
                near = F.lower(tail(F.concat(before, tail(x["z"]["gap"]))))
                return F.struct((x["at"] + size(x["z"]["gap"])).alias("start"), x["z"]["hit"].alias("hit"), near.alias("near"))

            return F.transform(F.arrays_zip(both.alias("z"), ends.alias("at")), at)

        every = let(F.transform(both, lambda z: tail(F.concat(z["gap"], z["hit"]))), placed)
        spans = F.transform(F.filter(every, lambda m: valid(kind, m["hit"])), scored)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)

    gaps = F.split(text, pattern, -1)
    spans = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) > 0, let(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")), spans_in)),
    )
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    looks = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    return F.coalesce(F.when(looks & text.rlike("@" if kind == "email" else "[0-9]"), spans), empty)


def find_pii(docs: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """Adds <prefix><kind> for each kind and keeps all other columns: arrays of (kind, start, end, score).

    Base kinds keep every confirmed match, whatever its score. IBANs must pass mod 97; social security
    numbers need a context word. Null text: empty arrays. Offsets are code points, end exclusive.
    Names of the added columns must be free; a column of such a name is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({f"{prefix}{k}": found(k, text) for k in PATTERNS})


def spans_of(kinds, prefix: str = "pii_") -> Column:
    return F.concat(*[F.col(f"{prefix}{k}") for k in kinds])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with each found span replaced by its kind in brackets; spans that overlap are merged.

    Null text stays null. Rows and all other columns are kept.
    """
    names, own = docs.columns, f"_{uuid.uuid4().hex}_"
    text = F.col(text_col)
    given = F.coalesce(text, F.lit(""))
    # bytes are cut where they stand, so places are of bytes here
    spans = F.array_sort(F.concat(*[F.transform(found(k, given, F.octet_length), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in PATTERNS]))

    def cut(raw: Column, a: Column, n: Column) -> Column:
        return F.substring(raw, (a + 1).cast("int"), n.cast("int")).cast("string")

    def replaced(raw: Column) -> Column:
        def by(reached: Column) -> Column:
            rows = F.arrays_zip(F.col(own).alias("s"), reached.alias("at"))
            fresh = F.filter(rows, lambda r: r["s"]["start"] >= r["at"])
            parts = F.transform(fresh, lambda r: F.concat(cut(raw, r["at"], r["s"]["start"] - r["at"]), F.lit("["), F.upper(r["s"]["kind"]), F.lit("]")))
            last = F.greatest(F.element_at(F.col(own), -1)["end"], F.element_at(reached, -1))
            return F.concat(F.array_join(parts, ""), cut(raw, last, F.octet_length(raw) - last))

        return let(running(F.transform(F.col(own), lambda s: s["end"]), lambda a, b: F.greatest(a, b)), by)

    out = docs.withColumn(own, spans)
    return out.withColumn(text_col, F.when(F.size(own) > 0, let(text.cast("binary"), replaced)).otherwise(text)).select(*names)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def percents(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document; scores: each span's score in percent, in the order of spans."""
    out = find_pii(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("text")
    return out.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(spans_of(BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(spans_of(PATTERNS)).alias("spans"),
        percents(spans_of(PATTERNS)).alias("scores"),
    )


def _sql() -> str:
    """DuckDB SQL of op8_pii, from the patterns as they are given."""
    digits = "translate(hit, ' -().+', '')"
    luhn_ = f"list_sum([CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INT) ELSE [0,2,4,6,8,1,3,5,7,9][CAST({digits}[i] AS INT) + 1] END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0"
    moved = "(hit[5:] || hit[1:4])"
    checks = {
        "email": "true",
        "ip": "len([p FOR p IN string_split(hit, '.') IF length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')]) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn_} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce([CAST(0 AS BIGINT)] || [CAST(CASE WHEN c >= 'A' THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT) FOR c IN string_split({moved}, '')], lambda a, v: (a * (CASE WHEN v >= 1000 THEN 100 ELSE 10 END) + v % 1000) % 97) = 1",
        "ssn": "true",
    }
    parts, cols = [], []
    for k, pattern in PATTERNS.items():
        near = f"lower(substring(t, greatest(start - {CONTEXT}, 0) + 1, least(start, {CONTEXT})))"
        told = " OR ".join(f"contains({near}, '{w}')" for w in WORDS[k])
        helped = "" if k in BASE else f" AND ({told} OR {SCORES[k]} >= {LEAST})"
        score = f"CAST(round(100 * least(1.0, {SCORES[k]} + CASE WHEN {told} THEN {BONUS} ELSE 0 END)) AS INT)"
        parts.append(f"""m_{k} AS (SELECT doc_id, r, t, unnest(regexp_extract_all(t, '{pattern}', 0)) hit, unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}', 0)))) gap, unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) i FROM d),
p_{k} AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) - length(hit) AS BIGINT) start FROM m_{k}),
a_{k} AS (SELECT r, count(*) n, string_agg('{k}:' || start || ':' || (start + length(hit)), ',' ORDER BY start) s, string_agg(CAST({score} AS VARCHAR), ',' ORDER BY start) c FROM p_{k} WHERE {checks[k]}{helped} GROUP BY r)""")
        cols.append(k)
    base = "concat_ws(',', " + ", ".join(f"a_{k}.s" for k in BASE) + ")"
    every = "concat_ws(',', " + ", ".join(f"a_{k}.s" for k in PATTERNS) + ")"
    scores = "concat_ws(',', " + ", ".join(f"a_{k}.c" for k in PATTERNS) + ")"
    counts = ", ".join(f"coalesce(a_{k}.n, 0) n_{k}" for k in BASE)
    joins = " ".join(f"LEFT JOIN a_{k} USING (r)" for k in cols)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER () r FROM documents),\n{',\n'.join(parts)}\nSELECT doc_id, {counts}, sha256({base}) base_sha256, {every} spans, {scores} scores FROM d {joins}"


QUERIES = {"op8_pii": op8_pii}
SQL = {"op8_pii": _sql()}
