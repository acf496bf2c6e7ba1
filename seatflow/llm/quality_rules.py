"""Quality rules: base counts per text, then robust multivariate outliers (native).

Each document gives a vector of transformed statistics (``FEATURES``).  Per
language and source the minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps: start from the documents closest to
the median in every coordinate, then repeat: centre and covariance of the
chosen ``support`` share, squared Mahalanobis distances, choose the closest
again.  A document whose distance under the last estimate passes ``limit`` is
rejected.

All of it is grouped sums.  The share is chosen from a histogram of
log-distances with bins of fixed width (no sort of a group, no approximate
sketch), so results do not depend on partitioning and a source that holds a
third of all documents costs one partially aggregated row per task and bin.
Medians come from the same histograms over values on a fixed grid.  Each
coordinate has a noise floor added to its variance: shares that are zero in
most documents would otherwise have none.  Groups below ``min_group``
documents take the estimate over all documents.

Defined cases: a null text has no words; a null language or source is a value
of its own; documents that fail the base rules take no part in the estimates;
repeated rows count as often as they appear; an empty table gives an empty
result.  Extra columns are ignored by ``quality_report`` and kept by
``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatflow.llm.common import WORD, no_space, stored, whole

MIN_WORDS = 50
SUPPORT = 0.75
STEPS = 3
MIN_GROUP = 200
# squared distance that rejects; beyond the 0.99999999 quantile (46) of the
# chi-square law with five degrees, as clean shares have heavy tails
LIMIT = 50.0
GRID = 256.0
BINS_PER_E = 32.0
# coordinate: (expression over the counts, noise floor as standard deviation)
FEATURES = {
    "word_len": ("ln(word_chars / n_words)", 0.08),
    "symbols": ("ln(1 + 20 * n_symbols / n_words)", 0.25),
    "repeats": ("n_repeat_words / n_words", 0.08),
    "dup_lines": ("ln(1 + n_dup_lines)", 0.5),
    "capitals": ("n_capitals / word_chars", 0.06),
}
_P = len(FEATURES)
_X = tuple(f"x{i}" for i in range(_P))


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more.

    Window keys with their positions are sorted; a position whose neighbour
    has the same key is repeated.  Positions in order then cover three words
    each, less what the next one covers as well.
    """
    n = F.size("words")
    keys = F.transform(F.arrays_zip(F.slice("words", 1, n - 2).alias("a"), F.slice("words", 2, n - 2).alias("b"),
                                    F.slice("words", 3, n - 2).alias("c")),
                       lambda z: F.xxhash64(z["a"], z["b"], z["c"]))
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(keys)


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_capitals."""
    text = whole(F.col("text"))
    df = docs.withColumns({"words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                           "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))})
    df = df.withColumn("keys", _repeat_words())
    df = df.withColumn("repeated", F.size(F.array_distinct("keys")) < F.size("keys"))
    pos = F.array_sort(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.withColumn("order", F.when(F.col("repeated"), pos))
    last = F.size("order") - 1
    near = F.filter("order", lambda x, i: (
        (i > 0) & (F.get("order", i - 1)["k"] == x["k"]) | (i < last) & (F.get("order", i + 1)["k"] == x["k"])))
    df = df.withColumn("at", F.array_sort(F.transform(near, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    plain = no_space(F.col("text"))
    return df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(plain).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("repeated"), covered).otherwise(0).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    }).drop("words", "lines", "keys", "repeated", "order", "at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(df: DataFrame) -> DataFrame:
    """Adds the coordinates on the grid; null where the base rules fail."""
    ok = ~base_failed()
    return df.withColumns({x: F.when(ok, F.round(F.expr(e) * GRID) / GRID)
                           for x, (e, _) in zip(_X, FEATURES.values())})


def _share_cut(hist: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Per key the smallest value whose rows, with all below, reach the share.
    ``hist`` has one row per key and value."""
    run = Window.partitionBy(*keys).orderBy(value)
    every = Window.partitionBy(*keys)
    return hist.withColumn("reached", F.sum("n").over(run) >= share * F.sum("n").over(every)).filter(
        "reached").groupBy(*keys).agg(F.min(value).alias(name))


def _distance(prefix: str = "e") -> Column:
    """Squared Mahalanobis distance through the inverse Cholesky factor."""
    e = F.col(prefix)
    dx = [F.col(x) - e[f"m{i}"] for i, x in enumerate(_X)]
    total = F.lit(0.0)
    for i in range(_P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + e[f"w{i}{j}"] * dx[j]
        total = total + y * y
    return total


def _moments(rows: DataFrame) -> DataFrame:
    """Centre, covariance (with noise floors) and its inverse Cholesky factor
    per group, solved column by column."""
    aggs = [F.count(F.lit(1)).alias("cnt")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)]
    aggs += [F.avg(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i in range(_P) for j in range(i + 1)]
    g = rows.groupBy("grp").agg(*aggs)
    floors = [f for _, f in FEATURES.values()]
    g = g.withColumns({f"c{i}{j}": F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
                       + (floors[i] ** 2 if i == j else 0.0) for i in range(_P) for j in range(i + 1)})
    for j in range(_P):
        sq = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        g = g.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - sq, F.lit(floors[j] ** 2 / 4))))
        for i in range(j + 1, _P):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            g = g.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - dot) / F.col(f"l{j}{j}"))
    for j in range(_P):
        g = g.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, _P):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            g = g.withColumn(f"w{i}{j}", -dot / F.col(f"l{i}{i}"))
    keep = [f"m{i}" for i in range(_P)] + [f"w{i}{j}" for i in range(_P) for j in range(i + 1)]
    return g.select("grp", F.struct(*keep).alias("e"))


def _group_of(lang: str = "lang", source: str = "source") -> Column:
    return F.struct(F.col(lang), F.col(source))


def estimate(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS,
             min_group: int = MIN_GROUP) -> DataFrame:
    """grp (language and source; null: all documents) and its estimate ``e``.
    ``vectors``: lang, source and the coordinates; rows with nulls are out."""
    rows = vectors.filter(F.col(_X[0]).isNotNull()).select("lang", "source", *_X)
    # every document counts for its own group and for the whole corpus
    rows = rows.withColumn("grp", F.explode(F.array(_group_of(), F.lit(None).cast(
        rows.select(_group_of().alias("g")).schema["g"].dataType)))).drop("lang", "source")
    # start: closest to the median, in units of the noise floor
    long = rows.select("grp", F.posexplode(F.array(*_X)).alias("i", "v"))
    med = _share_cut(long.groupBy("grp", "i", "v").agg(F.count(F.lit(1)).alias("n")), ["grp", "i"], "v", 0.5, "med")
    med = stored(med.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("i", "med"))).alias("med")),
                 "mcd-medians")
    d = sum(((F.col(x) - F.col("med")[i]) / f) ** 2 for i, (x, (_, f)) in enumerate(zip(_X, FEATURES.values())))
    centred = _join_grp(rows, med).withColumn("d", d).drop("med")
    est = None
    for _ in range(steps + 1):
        binned = centred.withColumn("bin", F.floor(F.log(F.col("d") + 1e-9) * BINS_PER_E).cast("int"))
        cut = _share_cut(binned.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")), ["grp"], "bin", support,
                         "cut")
        cut = stored(cut, "mcd-cut")
        est = stored(_moments(_join_grp(binned, cut).filter("bin <= cut")), "mcd-estimate")
        centred = _join_grp(rows, est).withColumn("d", _distance()).drop("e")
    # the chosen share is too compact: scale distances so that their median is
    # that of a chi-square law with as many degrees as coordinates (4.35 for 5)
    binned = centred.withColumn("bin", F.floor(F.log(F.col("d") + 1e-9) * BINS_PER_E).cast("int"))
    mid = _share_cut(binned.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")), ["grp"], "bin", 0.5, "mid")
    size = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"))
    scale = F.greatest(F.lit(1.0), F.exp((F.col("mid") + 0.5) / BINS_PER_E) / (_P * (1 - 2 / (9 * _P)) ** 3))
    out = _join_grp(_join_grp(est, mid), size).withColumn("scale", scale)
    return out.filter((F.col("docs") >= min_group) | F.col("grp").isNull()).select("grp", "e", "scale")


def _join_grp(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    b = b.withColumnRenamed("grp", "_grp")
    return a.join(b, F.col("grp").eqNullSafe(F.col("_grp")), how).drop("_grp")


def _judged(rows: DataFrame, vectors: DataFrame, limit: float) -> DataFrame:
    """``rows`` (with coordinates) plus ``distance`` and ``kept``."""
    est = stored(estimate(vectors), "mcd-final")
    own = est.filter("grp is not null")
    # one row over all documents; none when no document passes the base rules
    rest = est.filter("grp is null").select(F.col("e").alias("e_all"), F.col("scale").alias("scale_all"))
    one = rest.withColumn("k", F.lit(1))
    rows = _join_grp(rows.withColumn("grp", _group_of()), own, "left").withColumn("k", F.lit(1))
    rows = rows.join(F.broadcast(one), "k", "left")
    rows = rows.withColumns({"e": F.coalesce("e", "e_all"), "scale": F.coalesce("scale", "scale_all")})
    rows = rows.withColumn("distance", _distance() / F.col("scale"))
    return rows.withColumn("kept", ~base_failed() & F.coalesce(F.col("distance") <= limit, F.lit(False))).drop(
        "grp", "k", "e", "e_all", "scale", "scale_all")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the distance per document."""
    slim = docs.select("doc_id", "lang", "source", "text")
    slim = stored(_vector(counts(slim)).drop("text"), "quality-counts")
    return _judged(slim, slim, limit).select("doc_id", *COUNTS, base_failed().alias("base_failed"), "kept", "distance")


def keep_good(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents that are kept, all columns as they came."""
    cols = docs.columns
    rows = _vector(counts(docs.select(F.struct(*cols).alias("doc"), "lang", "source", "text")))
    rows = stored(rows.drop("text"), "quality-docs")
    return _judged(rows, rows.select("lang", "source", *_X), limit).filter("kept").select("doc.*")
