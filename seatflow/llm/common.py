"""Expressions and helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.session import reliable_checkpoint

# word characters as every operator reads them: all but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def no_space(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACE, "")


def held_out(doc_id: Column) -> Column:
    """The third of documents (by crc32 of the id as text) that no model may
    learn from; a null id counts as text '' (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder named by the cluster and read back."""
    return reliable_checkpoint(df, name)
