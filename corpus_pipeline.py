"""The corpus pipeline: five stages from raw documents to token ids.

Each stage reads what its predecessor wrote as Parquet. All but the last return the
columns of ``documents``; a stage's decisions are that rows go or that texts change.
An empty table passes through all stages; nulls are treated as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common, decontaminate, line_dedup, minhash, pieces, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    raw = common.table(spark, sf_dir, "documents")
    return quality_rules.reject(docs, quality_rules.fit(spark, raw, common.table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites, of one word or more, stay in one document; documents that had words and are left without any go."""
    (prefix,) = common.fresh(docs, "ld_")
    out = line_dedup.dedup_lines(docs, prefix=prefix, min_words=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{prefix}n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    emptied = (F.col(f"{prefix}n_removed") > 0) & ~F.col("text").rlike(common.WORD)
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the next best segmentations."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("piece_encoding", tokens),
]

#: A learned verdict, a similarity search and a lattice search: not for SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs, written = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
        if written is not None:
            common.discard(written)  # what the next stage reads is there
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
