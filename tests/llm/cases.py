"""Tables that every operator has to survive."""

from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(n: int, seed: int = 0) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


EDGES = [
    (1, text(60, 1), "en", "a", 1),
    (2, text(60, 1), "en", "a", 1),  # a copy
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "  \n\t ", "de", "a", 5),
    (None, text(30, 2), "en", None, 3),
    (6, text(20_000, 3), "en", "a", 4),  # very long
    (7, "x" * 50_000, "en", "a", 4),  # one word
    (8, "naïve 日本語 😀 ▁ \u0000 test", "fr", "a", 4),
    (9, text(60, 1), "en", "a", 1),
    (9, text(60, 1), "en", "a", 1),  # a repeated row
    (10, "one", "en", "a", 1),
]
NAMES = ["g", "n", "s", "key", "chunk", "unit", "rep", "component", "u", "v", "_salt", "places", "digest", "value", "page_id", "item_id", "pii_email", "start", "end", "kind", "rank", "shard", "bucket", "family", "html_"]


def documents(spark, rows=EDGES, clash: bool = True):
    """A table of documents, with further columns whose names operators use inside."""
    extra = NAMES if clash else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame([(*r, *["?"] * len(extra)) for r in rows], schema)


def ids(rows) -> list:
    return sorted((r[0] for r in rows), key=lambda x: (x is None, x))
