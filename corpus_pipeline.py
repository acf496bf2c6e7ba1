"""Corpus pipeline: raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame that is written as Parquet and reread as the
next one's docs.  All but the last return the columns of ``documents``; the
last one returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seatflow.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from seatflow.session import reliable_checkpoint


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no multivariate outliers."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per near-duplicate class."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in a sequence."""
    return packing.packing_report(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix),
          ("pack", pack)]

# sampling, consistent weighted hashing and the genetic search have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
