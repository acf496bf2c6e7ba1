"""Interaction of five text filters: what each removes in every order.

Filters: A under 50 words; B fewer than 65 distinct words in 100; C more than
5 letters A-Z in 100 code points; D any of ``#$%&*|``; E the same text as a row
with a smaller doc_id, anywhere in the table.

Method: E is an existential self-join.  Rows whose text hash occurs under more
than one doc_id meet, in a left-semi join on hash and exact text, the smallest
doc_id of each text; a smaller one marks E.  The ids so marked are united with
the ids that fail A to D, grouped by (id, hash, part), and their bits combined;
documents are then counted per part and bit combination.  At most 32
combinations a part remain, and every order's steps are sums over them.

Texts are shuffled only for hashes that repeat.  A group of copies is spread
over salts by its size, and the smallest id of each text, found with map-side
combining, is repeated once per salt (one per ``SALT_ROWS`` copies).

Defined cases: null texts are empty and equal to each other; a null source is
part ''; a null doc_id is smaller than none, and no other is smaller than it;
rows that repeat an id are counted each, and copies under one id don't fail E
by each other; a document counts as good or toxic if any label row of its id
says so; very long texts are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatflow.llm.common import stored, whole

FILTERS = "ABCDE"
E_BIT = 16
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SALT_ROWS = 2000
SPREAD = 16  # salts of the slim join that finds the rows of repeated hashes
_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_MARK = bytes(c for c in range(256) if c not in b"#$%&*|")
_INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point


def failures(text: bytes) -> int:
    """Bits of the failed conditions A (1), B (2), C (4), D (8) of one text."""
    words = text.split()  # of bytes: at ASCII white space
    capitals = len(text.translate(None, _NOT_CAPITAL))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS * len(text.translate(None, _INNER))) << 2
            | (len(text.translate(None, _NOT_MARK)) > 0) << 3)


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash and bits of A to D of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), whole(F.col("text")).alias("text"))
    rows = rows.select("doc_id", "part", _hash(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = pa.array([failures(t.as_py()) for t in b.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("hash"), bits],
                                             ["doc_id", "part", "hash", "bits"])

    return rows.mapInArrow(judge, f"doc_id {kind}, part string, hash binary, bits int")


def repeated_ids(docs: DataFrame, marked: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, hash, part of the rows whose text a smaller doc_id has too."""
    groups = marked.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    groups = groups.filter("lo < hi").select("hash", F.ceil(F.col("n") / salt_rows).alias("salts"),
                                             F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), whole(F.col("text")).alias("text"))
    rows = rows.withColumn("hash", _hash(F.col("text"))).withColumn(
        "spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int"))
    rows = stored(rows.join(groups, ["hash", "spread"]).drop("spread"), "audit-copies")
    first = rows.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("salts").alias("salts"))
    first = first.select("hash", "text", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias(
        "salt"))
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))).alias("a")
    first = first.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("hash", "salt", "text")]
    found = rows.join(first, [*same, F.col("b.first") < F.col("a.doc_id")], "left_semi")
    return found.select("doc_id", "hash", "part")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (n), good and toxic ones per part and bit combination."""
    marked = stored(marks(docs), "audit-marks")
    copies = repeated_ids(docs, marked)
    key = ["doc_id", "hash", "part"]
    failed = marked.select(*key, "bits", F.lit(1).cast("long").alias("n")).unionByName(
        copies.select(*key, F.lit(E_BIT).alias("bits"), F.lit(0).cast("long").alias("n")))
    ids = failed.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    told = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return ids.join(told, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def _steps(spark) -> DataFrame:
    """Every order's steps: the filter's bit and those of the filters before."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            rows.append(("".join(FILTERS[x] for x in order), step + 1, 1 << f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley."""
    counted = stored(combinations(docs, labels), "audit-combinations")
    # a step depends on its filter and on which filters came before: 80 such pairs
    n = len(FILTERS)
    cells = counted.withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(n * (1 << n) - 1))))
    cells = cells.withColumn("bit", F.expr(f"shiftleft(1, pair % {n})")).withColumn(
        "before", F.floor(F.col("pair") / n).cast("int")).filter(F.col("before").bitwiseAND(F.col("bit")) == 0)
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0

    def total(when: Column, of: str = "n") -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")

    sums = cells.groupBy("part", "bit", "before").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"))
    out = sums.join(_steps(docs.sparkSession), ["bit", "before"])
    over_orders = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows
    return out.withColumn("shapley", over_orders.cast("long")).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
