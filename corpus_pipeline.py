"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, BPE.

Every stage works on all that the stage before kept. All but the last return the columns of ``documents``; the last returns the
token ids and the decoded text of each document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from loomspark.llm.common import apart, keep_rows, materialize, numbered, table
from loomspark.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the frequency limits leave the others' texts."""
    return quality_rules.without_lines(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""

    def first(docs: DataFrame) -> DataFrame:
        t = numbered(docs)
        return keep_rows(t, exact_dedup.exact_dedup(t).filter("kept"))

    return apart(docs, first, "doc_id", "text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: the one with the smallest doc_id (null last), then by its set's digest, then the first."""

    def first(docs: DataFrame) -> DataFrame:
        t = numbered(docs)
        found = minhash.near_dedup(t).select("root", "_rid", "doc_id", "digest")
        best = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "_rid")).alias("f"))
        return keep_rows(t, best.select("f._rid").union(found.filter("root is null").select("_rid")))

    return apart(docs, first, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every row of the mix."""
    return bpe.encode_decode(docs, vocabulary()).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mix_sources", mix), ("bpe_encode_decode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages (token ids, components of near copies); the tests hold them against brute force.
ORACLE_SQL = None
