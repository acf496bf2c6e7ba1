"""Exact dedup with skew-safe combining (native).

Texts are equal when they are identical after every ASCII white-space
character is deleted.  A group of copies is combined in three stages, each of
which groups by the digest **and the whole normalised text**, so that two
texts of one digest never merge:

1. inside each input partition (Spark's partial aggregation),
2. per (digest, salt): the salt comes from the doc_id and spreads a group of
   copies, however large, over ``salts`` tasks,
3. the salt winners per digest (at most ``salts`` rows for a text).

Defined cases: a null text is an empty one; all empty and white-space texts
form one group.  The row with the most code points in its original text
stays, then the smallest doc_id (a null doc_id loses to any other), then the
greatest text.  Of rows that agree in all of these exactly one is kept.  An
empty table gives an empty result.  Other columns pass through
``deduplicate`` untouched and are ignored by ``decisions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatflow.llm.common import no_space, stored, whole

SALTS = 64


def _salt(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(salts)).cast("int")


def _digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keyed(docs: DataFrame, salts: int, *more: Column) -> DataFrame:
    """doc_id, norm, digest, salt and the rank of a row in its group.  ``~id``
    falls as the id rises and, unlike ``-id``, never overflows."""
    ident = F.col("doc_id").cast("long")
    norm = no_space(F.col("text"))
    return docs.select(
        ident.alias("doc_id"), norm.alias("norm"), _digest(norm).alias("digest"), _salt(ident, salts).alias("salt"),
        F.struct(F.length(whole(F.col("text"))).alias("chars"), F.bitwise_not(ident).alias("id")).alias("rank"), *more)


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, norm, the winner's rank, group size
    and the salts its copies carry (at most ``salts`` of them)."""
    by_salt = _keyed(docs, salts).groupBy("digest", "salt", "norm").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    return by_salt.groupBy("digest", "norm").agg(
        F.max("rank").alias("rank"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))


def _settled(docs: DataFrame, salts: int) -> tuple[DataFrame, list[str]]:
    """The groups without their texts, stored, and the columns that name one:
    the digest, or digest and norm where texts of one digest differ (none in
    practice)."""
    slim = stored(groups(docs, salts).drop("norm"), "exact-groups")
    clash = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    if clash.isEmpty():
        return slim, ["digest"]
    return groups(docs, salts), ["digest", "norm"]


def decisions(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    won, name = _settled(docs, salts)
    on = [*name, "salt"]
    won = won.select(*name, F.explode("salts").alias("salt"), F.col("rank").alias("best"), "group_size")
    joined = _keyed(docs, salts).select("doc_id", "rank", *on).join(won, on).withColumn(
        "winner", F.col("rank").eqNullSafe(F.col("best")))
    # of repeated winner rows (equal ids, so equal salts) one is kept
    first = F.row_number().over(Window.partitionBy(*on).orderBy(F.col("winner").desc()))
    return joined.select(
        "doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size",
        (F.col("winner") & (first == 1)).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with every column they came with.  Whole rows travel
    once, to meet the winner of their group in the winner's salt."""
    won, name = _settled(docs, salts)
    on = [*name, "salt"]
    won = won.select(*name, _salt(F.bitwise_not("rank.id"), salts).alias("salt"), F.col("rank").alias("best"))
    rows = _keyed(docs, salts, F.struct(*docs.columns).alias("doc"))
    kept = rows.select("doc", "rank", *on).join(won, on).filter(F.col("rank").eqNullSafe(F.col("best")))
    # of repeated winner rows (equal ids, so equal salts) the greatest text stays
    place = F.row_number().over(Window.partitionBy(*on).orderBy(whole(F.col("doc.text")).desc()))
    return kept.withColumn("place", place).filter("place = 1").select("doc.*")
