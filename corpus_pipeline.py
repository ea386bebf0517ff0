"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of documents; the
last returns the mix: doc_id, size, source_size, target, copies and taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import bounded_batches, free_names, staged, staged_and_seen, unstage
from ferrule.llm.decontam import find_contamination
from ferrule.llm.line_dedup import drop_boilerplate_lines
from ferrule.llm.minhash import BROADCAST_IDS, near_duplicates
from ferrule.llm.mixing import mix_sources
from ferrule.llm.quality import score_quality


def _shielded(docs: DataFrame, made: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs; those named like one that the operator makes go through it under another name."""
    names = [free_names(docs, c)[0] if c.lower() in made else c for c in docs.columns]
    out = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]))
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in zip(docs.columns, names)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model accepts.

    Null and empty texts have no evidence and go; repeated rows are judged alike; an empty table stays empty; other columns are carried.
    """
    bounded_batches(spark)
    return _shielded(docs, ("weak_posterior", "quality_score", "quality_keep"), lambda d: score_quality(d).where("quality_keep"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its host's boilerplate lines; n_chars follows the text. No row goes, null texts stay null."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _shielded(docs, ("n_lines", "n_dropped"), lambda d: drop_boilerplate_lines(d).withColumn("n_chars", n_chars))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id (and, where ids repeat, hash of the text).

    Rows without doc_id or without words stay. Rows are named by doc_id and text, so a text that resembles nothing stays even where its
    id is repeated; equal rows are copies, and one of them stays.
    """
    bounded_batches(spark)
    found, seen = staged_and_seen(near_duplicates(docs), "pipeline-near", gone=F.count_if(~F.col("first")))
    gone_id, gone_body = free_names(docs, "gone_id", "gone_body")
    named = found.select(F.col("doc_id").alias(gone_id), F.col("body").alias(gone_body), "first", "n_shingles")
    gone = named.where("not first").select(gone_id, gone_body).distinct()
    many = named.where("first and n_shingles > 0").where(F.col(gone_id).isNotNull()).groupBy(gone_id, gone_body).count().where("count > 1").drop("count")
    many, repeated = staged_and_seen(many, "pipeline-repeats", n=F.count("*"))
    same = (F.col("doc_id") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_body))
    out = docs.join(F.broadcast(gone) if seen["gone"] <= BROADCAST_IDS else gone, same, "left_anti")
    if repeated["n"]:
        out = out.join(many, same, "left_anti").unionByName(out.join(many, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its own order or another. Null and empty texts hold none; repeated rows are treated alike."""
    bounded_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _shielded(docs, ("hits",), lambda d: find_contamination(d, benchmark).where(F.size("hits") == 0))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document that bring every source near its target weight.

    Null ids, null texts and repeated rows are documents like any other; a null source is a source of its own.
    """
    return mix_sources(docs, carry=[])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: The classifier's scores cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        unstage(before)
    return docs
