"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native).

Each document draws the exponential key ``-ln(u) / w`` (u: a hash of its id,
w: its quality weight).  Documents taken in key order are a weighted sample
without replacement.  A source whose target is t words and whose size is s
words gives floor(t / s) complete epochs first; the rest of its budget is
filled by the documents with the smallest keys, up to the unit whose middle
passes the budget.

No ordering of a whole source in one task: keys fall into buckets of equal width
in ln(key).  Whatever its weight, an exponential key lies in a bucket of width
1/F with a chance of at most 1/(e F), so no bucket holds more than that share of a
source, letters or none.  The sizes per (source, coarse bucket) are summed map-side,
then those per fine bucket inside the one coarse bucket in which the budget ends, and
only the fine bucket in which it ends is sorted row by row.  Both numbers of buckets grow
with the root of the number of rows.  The result is one cut per source; taking a
document is then a comparison.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; rows that repeat a doc_id in a source draw one key and are taken
or left together; a null doc_id draws the key of the text 'null'; an empty
table gives an empty result; a source without words has target 0.  Texts of any
length are read whole.  Extra columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatflow.llm.common import n_words, no_space, stored, whole

SEED = "mix-1"
SOURCE_WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
ROWS_PER_BUCKET = 20_000
SALTS = 64


def quality_weight(text: Column) -> Column:
    """Share of letters among the non-space characters, 0.05 at least."""
    letters = F.length(F.regexp_replace(whole(text), r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.lit(1), F.length(no_space(text))))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(ident), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / weight


def _bucket(key: Column, buckets: int) -> Column:
    """Fine bucket; ``buckets`` of them make a coarse one, ``buckets`` of those
    span a factor e."""
    return F.floor(F.log(key) * (buckets * buckets)).cast("long")


def targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target.  ``sizes`` has one row per source.

    Sources filled to ``most`` times their size share the excess out by weight
    until none is above.  That is water-filling: in rising order of
    most * size / weight the first k sources are full, for the smallest k
    whose remaining level is not above the next ratio.  One row per source is
    ordered here, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), pos + 1).cast("double"))
    cap = F.col("source_size") * most
    w = w.withColumn("ratio", cap / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, all_w = F.sum("source_size").over(every), F.sum("w").over(every)
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = left / (all_w - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.when(level <= F.col("ratio"), level))
    # null: every source is full (all are empty)
    w = w.withColumn("level", F.max("level").over(every))
    first = F.when(F.col("level").isNull(), cap.cast("double")).otherwise(
        F.least(cap.cast("double"), F.col("level") * F.col("w")))
    return w.select("source", "source_size", first.alias("target"))


def measured(docs: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and key, and the whole row as a struct."""
    text = F.col("text")
    w = quality_weight(text) if weight is None else weight
    return docs.select("doc_id", "source", n_words(text).alias("mix_size"),
                       exponential_key(F.col("doc_id"), w, seed).alias("mix_key"), F.struct("*").alias("mix_row"))


def _last(keyed: DataFrame, budgets: DataFrame, bucket: str) -> DataFrame:
    """source, the bucket in which its budget ends, the words before it, and the
    budget.  ``budgets`` has source, budget and the words before the first bucket."""
    run = Window.partitionBy("source").orderBy(bucket)
    hist = keyed.groupBy("source", bucket).agg(F.sum("mix_size").alias("words"))
    hist = _null_safe(hist.withColumn("sofar", F.sum("words").over(run) - F.col("words")), budgets, "source")
    hist = hist.withColumn("before", F.col("before") + F.col("sofar"))
    return hist.filter("before < budget and before + words >= budget").select("source", bucket, "before", "budget")


def cuts(slim: DataFrame, weights=SOURCE_WEIGHTS, most: int = MOST_EPOCHS) -> tuple[DataFrame, int]:
    """Per source: size, target, epochs and the cut; and the bucket count,
    which follows the root of the number of rows."""
    buckets = max(8, math.isqrt(slim.count() // ROWS_PER_BUCKET))
    plan = targets(slim.groupBy("source").agg(F.sum("mix_size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long"))
    plan = stored(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    keyed = slim.withColumn("bucket", _bucket(F.col("mix_key"), buckets))
    keyed = keyed.withColumn("coarse", F.floor(F.col("bucket") / buckets))
    wide = stored(_last(keyed, plan.select("source", "budget", F.lit(0).cast("long").alias("before")), "coarse"), "mix-coarse")
    inner = _null_safe(keyed, wide.select("source", "coarse"), "source", "coarse")
    last = stored(_last(inner, wide.drop("coarse"), "bucket"), "mix-last")
    rows = _null_safe(keyed, last, "source", "bucket")
    unit = rows.groupBy("source", "mix_key", "doc_id", "before", "budget").agg(F.sum("mix_size").alias("words"))
    inside = Window.partitionBy("source").orderBy("mix_key", "doc_id")
    passed = F.col("before") + F.sum("words").over(inside) - F.col("words") / 2
    cut = unit.withColumn("passed", passed).filter("passed <= budget").groupBy("source").agg(
        F.max(F.struct("mix_key", "doc_id")).alias("cut"))
    plan = _null_safe(plan, last.select("source", F.col("bucket").alias("last_bucket")), "source", how="left")
    return _null_safe(plan, cut, "source", how="left"), buckets


def _null_safe(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    b = b.withColumnsRenamed({c: f"_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return a.join(b, cond, how).drop(*(f"_{c}" for c in on))


def _times(docs: DataFrame, weights, most: int, seed: str, slim: DataFrame | None = None) -> DataFrame:
    rows = measured(docs, None, seed) if slim is None else slim
    if slim is None:
        slim = stored(rows.drop("mix_row"), "mix-sizes")
    plan, buckets = cuts(slim, weights, most)
    plan = plan.select("source", F.struct("source_size", "target", "epochs", "last_bucket", "cut").alias("mix_plan"))
    # a source may hold a third of all rows: its plan is repeated per salt
    plan = plan.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = _null_safe(rows, plan, "source", "mix_salt").drop("mix_salt")
    bucket = _bucket(F.col("mix_key"), buckets)
    within = F.struct("mix_key", "doc_id") <= F.col("mix_plan.cut")
    taken = F.when(bucket < F.col("mix_plan.last_bucket"), True).when(
        bucket == F.col("mix_plan.last_bucket"), F.coalesce(within, F.lit(False))).otherwise(False)
    return rows.withColumn("mix_times", F.col("mix_plan.epochs") + taken.cast("long"))


def mix_report(docs: DataFrame, weights=SOURCE_WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    slim = stored(measured(docs, None, seed).drop("mix_row"), "mix-sizes")
    return _times(docs, weights, most, seed, slim).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_plan.source_size").alias("source_size"),
        F.col("mix_plan.target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"))


def mix(docs: DataFrame, weights=SOURCE_WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns as
    they came.  Texts are not shuffled: a source's cut decides."""
    rows = _times(docs, weights, most, seed).filter("mix_times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_times"))).alias("mix_copy")
    return rows.select("mix_row", copies).select("mix_row.*")
