"""A corpus pipeline: five stages over documents, each of which works on all that the one before it kept.

Rows whose id is null cannot be named by a decision, so filtering stages keep them. Rows of one id share
its decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch
from strandloom.llm.decontamination import contaminated
from strandloom.llm.minhash import near_duplicates
from strandloom.llm.perplexity import classify
from strandloom.llm.pii import redact
from strandloom.llm.sentencepiece import encode
from strandloom.shipping import shipped

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's bounds."""
    verdicts = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, verdicts.where("not keep"))


@shipped
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates: five words, similarity 0.8."""
    return _without(docs, near_duplicates(docs, width=5, percent=80).where("not kept"))


@shipped
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@shipped
def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    out = redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


@shipped
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document."""
    return encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", scrub),
    ("SentencePiece encoding", tokenize),
]

#: Perplexities, minima and sampled segmentations are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
