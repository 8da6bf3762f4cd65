"""A training-data pipeline of five operators; each stage works on all that its predecessor kept.

The near-duplicate stage follows the contract of the SimHash query (four-word shingles, four bits). A document
is its doc_id: rows that repeat a doc_id stay or go together. All stages but the last return the columns of
documents. Mixing returns a document once for each whole time that the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import bpe, exact_dedup, mixing, quality, simhash
from topicloom.llm.common import cut, scratch, table

#: Ids that are broadcast to keep or repeat documents; beyond that both sides are shuffled.
BROADCAST_IDS = 500_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id (null is a value like any other) is among ids (column k__id)."""
    return docs.join(_small(cut(ids)), docs["doc_id"].eqNullSafe(F.col("k__id")), "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model) >= quality.PREDICT)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _keep(docs, exact_dedup.dedup(docs).where("kept").select(F.col("doc_id").alias("k__id")))


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of linked fingerprints."""
    found = simhash.near_duplicates(docs)
    return _keep(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("k__id")).distinct())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    took = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("k__id"), F.expr("cast(taken div size as int)").alias("k__n")).groupBy("k__id").agg(F.max("k__n").alias("k__n"))
    rows = docs.join(_small(cut(took)), docs["doc_id"].eqNullSafe(F.col("k__id")))
    return rows.withColumn("k__i", F.explode(F.sequence(F.lit(1), F.col("k__n")))).drop("k__id", "k__n", "k__i")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", distinct_fingerprints),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: Learnt models, seeded selection and byte-pair merges are not SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, f"stage{k + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
