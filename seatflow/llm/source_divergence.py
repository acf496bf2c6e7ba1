"""How sources of one language differ in their terms, exactly.

A term is a run of ASCII letters (A-Z lower-cased) and characters above ASCII.
A language keeps the V terms that at least ``MIN_DOCS`` of its documents have.
A count c of N kept occurrences stands for
p = 1 + floor(10^9 (c + 1) / (N + V)); two such values differ by
f(p, q) = floor((p - q)^2 / q).  Products run in whole decimals, quotients are
whole, so nothing is rounded.

Method (count cells): all that f needs of a term is its count here and there,
so terms are grouped by both counts and f is evaluated once per cell.  Part
``term`` ranks a group's cells (group count, language count) by value: cells of
one value are merged, their multiplicities summed up in rank order, and the
values that start below rank ``TOP`` are expanded to their terms, in UTF-8
order.  Part ``pair`` sums f times multiplicity over the cells (count here,
count there) of two sources.  Cells with a zero need no term pairs: they follow
from each source's own histogram of counts, V and f at count 0:

    sum f(a, b) = V f(0,0) + sum_a H(a) [f(a,0) - f(0,0)] + sum_b H'(b) [f(0,b) - f(0,0)]
                  + sum over terms that both have [f(a,b) - f(a,0) - f(0,b) + f(0,0)]

Documents are tokenised once; a worker adds up counts per (lang, source, term)
and hands them on whenever ``KEYS`` are held, each term once with its sources;
Spark deals them by (lang, term), so a hot source is spread over its terms, and
adds up the rest.  No group is collected
into one row or task: the tops come from bounded per-task tops.

Defined cases: null text, lang and source are ''; a group without any term
occurs with count 0 for every kept term; no kept term gives pairs of value 0;
repeated rows are documents of their own; ties rank by UTF-8 bytes of the item;
very long texts are read whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatflow.llm.common import stored

MIN_DOCS = 3
TOP = 200
ONE = 1_000_000_000
KEYS = 400_000
BYTES = 32 << 20  # of text read before counts are handed on
DOC = 1 << 40  # one document in a term's tally, occurrences below it
# every byte outside terms becomes a blank, A-Z become a-z
_TERMS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
COUNTS = "lang string, term string, groups array<struct<source: string, n: bigint, df: bigint>>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    keys = read = 0

    def out() -> Iterator[pa.RecordBatch]:
        # a term once per language, with the sources that have it
        for lang in sorted({g[0] for g in held}):
            own = [(source, tally) for (x, source), tally in held.items() if x == lang]
            size = [len(tally) for _, tally in own]
            term = pa.array((t for _, tally in own for t in tally), pa.binary()).dictionary_encode()
            place = term.indices.to_numpy()
            order = np.argsort(place, kind="stable")
            sums = np.fromiter((v for _, tally in own for v in tally.values()), np.int64, sum(size))[order]
            names = pa.array([source for source, _ in own], pa.string()).take(
                pa.array(np.repeat(np.arange(len(own)), size)[order]))
            groups = pa.StructArray.from_arrays([names, pa.array(sums % DOC), pa.array(sums // DOC)], ["source", "n", "df"])
            edges = np.searchsorted(place[order], np.arange(len(term.dictionary) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(term.dictionary)), term.dictionary.cast(pa.string()),
                 pa.ListArray.from_arrays(pa.array(edges, pa.int32()), groups)], ["lang", "term", "groups"])

    for b in batches:
        for lang, source, text in zip(b.column("lang"), b.column("source"), b.column("text")):
            group, text = (lang.as_py(), source.as_py()), text.as_py()
            tally = held.setdefault(group, {b"": 0})  # the empty term marks that the group occurs
            before, known = len(tally), tally.get
            for term, times in collections.Counter(terms(text)).items():
                tally[term] = known(term, 0) + times + DOC
            keys, read = keys + len(tally) - before, read + len(text)
            if keys > KEYS or read > BYTES:
                yield from out()
                held, keys, read = {}, 0, 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences (n) and documents (df) per lang, source and term, with the
    empty term once per group.  Rows that share lang and term share a task."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")],
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    part = rows.mapInArrow(_count, COUNTS).repartition("lang", "term")
    return part.select("lang", "term", F.inline("groups")).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"))


def _p(count: str, size: str) -> Column:
    """1 + floor(10^9 (count + 1) / (size + V)); decimals, since the product outgrows a long."""
    return F.expr(f"1 + (CAST({ONE} AS DECIMAL(12,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div "
                  f"CAST({size} + vocabulary AS DECIMAL(20,0))")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _cell_tables(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, size, lang_size, vocabulary) and the kept terms
    that each group has (lang, source, term, c, lang_c)."""
    # a language's sources of one term are few rows, and in one task already
    all_sources = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"lang_c": F.sum("n").over(all_sources), "in_docs": F.sum("df").over(all_sources)})
    rows = stored(counted.filter((F.col("term") == "") | (F.col("in_docs") >= min_docs)).select(
        "lang", "source", "term", F.col("n").alias("c"), "lang_c"), "divergence-rows")
    groups = rows.filter("term = ''").select("lang", "source")
    rows = rows.filter("term != ''")
    kept = rows.groupBy("lang", "term").agg(F.first("lang_c").alias("lang_c"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("c").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("lang_c").alias("lang_size"), F.count("*").alias("vocabulary"))
    none = F.lit(0).cast("long")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("size", "lang_size", "vocabulary")])
    return stored(groups, "divergence-groups"), rows


def top_terms(groups: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank of each group's over-represented terms."""
    key = ["lang", "source"]
    cells = rows.groupBy(*key, "c", "lang_c").agg(F.count("*").alias("n")).join(groups, key)
    cells = cells.select(*key, "c", "lang_c", "n", _p("c", "size").alias("p"), _p("lang_c", "lang_size").alias("q"))
    cells = stored(cells.filter("p > q").withColumn("value", F.expr(_f("p", "q"))).drop("p", "q"), "divergence-cells")
    by_value = Window.partitionBy(*key).orderBy(F.desc("value"))
    # a value holds a term at least, so no value behind the first `top` matters
    values = cells.groupBy(*key, "value").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(
        by_value)).filter(F.col("place") <= top)
    before = F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top)
    wanted = cells.join(values.select(*key, "value"), [*key, "value"]).select(*key, "c", "lang_c", "value")
    found = rows.join(wanted, [*key, "c", "lang_c"]).select(*key, F.col("term").alias("item"), "value")
    order = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def source_pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: how far each source is from each other
    source of its language, over all kept terms."""
    zero = groups.withColumn("p0", F.when(F.col("vocabulary") > 0, _p("0", "size")))
    g = zero.select("lang", "source", "size", "vocabulary", "p0")
    h = zero.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"), F.col("p0").alias("q0"))
    grid = g.join(h, "lang").filter("source != item")
    base = F.expr(_f("p0", "q0"))
    shares = [grid.select("lang", "source", "item", F.coalesce(F.col("vocabulary") * base, F.lit(0)).alias("value"))]

    # terms that one of the two has: its histogram of counts against the other's zero
    hist = rows.groupBy("lang", "source", "c").agg(F.count("*").alias("n"))
    one = grid.join(hist, ["lang", "source"]).withColumn("p", _p("c", "size"))
    here = F.expr(f"n * ({_f('p', 'q0')} - {_f('p0', 'q0')})")
    there = F.expr(f"n * ({_f('q0', 'p')} - {_f('q0', 'p0')})")
    one = one.groupBy("lang", "source", "item").agg(F.sum(here).alias("here"), F.sum(there).alias("there"))
    shares += [one.select("lang", "source", "item", F.col("here").alias("value")),
               one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias(
                   "value"))]

    # terms that both have: cells of the two counts, each pair of sources once
    a = rows.select("lang", "term", "source", "c")
    b = rows.select("lang", "term", F.col("source").alias("item"), F.col("c").alias("d"))
    both = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item", "c", "d").agg(
        F.count("*").alias("n"))
    both = both.join(grid, ["lang", "source", "item"]).withColumn("p", _p("c", "size")).withColumn(
        "q", _p("d", "item_size"))

    def joint(p: str, q: str, p0: str, q0: str) -> Column:
        return F.sum(F.expr(f"n * ({_f(p, q)} - {_f(p, q0)} - {_f(p0, q)} + {_f(p0, q0)})"))

    both = both.groupBy("lang", "source", "item").agg(joint("p", "q", "p0", "q0").alias("here"),
                                                      joint("q", "p", "q0", "p0").alias("there"))
    shares += [both.select("lang", "source", "item", F.col("here").alias("value")),
               both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias(
                   "value"))]
    out = shares[0]
    for s in shares[1:]:
        out = out.unionByName(s)
    out = out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return out.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    groups, rows = _cell_tables(docs, min_docs)
    parts = {"pair": source_pairs(groups, rows), "term": top_terms(groups, rows, top)}
    found = [d.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"),
                      F.col("rank").cast("int").alias("rank")) for part, d in parts.items()]
    return found[0].unionByName(found[1])
