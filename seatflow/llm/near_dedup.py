"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF
shingles, banded, verified by weighted Jaccard similarity.

Shingles are runs of five words (a shorter text is one shingle of all its
words).  A shingle's weight is its count in the text times an inverse document
frequency between 1 (in every document) and 2:

    idf = 1 + max(0, ln(N / max(df, floor))) / ln(SATURATE),  floor = max(2, N / SATURATE)

The frequency saturates: only shingles in more than one document in
``SATURATE`` weigh less than 2, and there can be at most ``SATURATE`` times the
mean number of shingles per document of those, whatever N is.  So that table
has a proven bound and is sent to every task.  It is found exactly: a sketch
of fixed size counts all shingles of all documents (a shingle's true count is
never above its cell's), and the shingles in cells that reach the floor are
then counted one by one.

Each text gets ``BANDS`` x ``ROWS`` samples, drawn with probability
proportional to weight and consistently over texts, so two texts agree in one
sample with the probability of their weighted Jaccard similarity.  Texts that
agree in a whole band are candidates; similarity itself is then computed from
the texts, exactly, and must reach ``THRESHOLD``.  With 10 bands of 3 a pair of
similarity 0.8 shares no band once in 1,300 times, one of 0.9 twice in 10^6.

No all-pairs of a bucket: identical shingle bags collapse first; then in each
bucket every member meets the bucket's leader, the member that shares most
buckets with others.  Where a bucket still holds several classes after that,
the members outside its largest class are queries against all of its members
of other classes, block by block inside the tasks; no pair is written out but
the verified links, one per query and class.  So every pair that shares a
bucket has been compared or lies inside one class.

Classes are connected components of the verified links.  Defined cases: null
text, empty text and text of white space have no shingle and are classes of
their own; rows that repeat both doc_id and text are one class; the class id is
the smallest doc_id of the class (null if all are null); an empty table gives
an empty result.  Extra columns are ignored by ``near_classes`` and kept by
``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatflow.llm.common import stored, whole
from seatflow.llm.textvec import SPACE, Spans, gather, mix, per_text, process_memory, runs, slices

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SATURATE = 1000
CELLS = 1 << 20
SLICE = 1 << 19
MEMBER_BLOCK, QUERY_BLOCK = 512, 128  # texts per block, on average
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- shingles ---------------------------------------------------------------

def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of consecutive texts, and each text's offset."""
    n_texts = len(off) - 1
    start, end = runs(~SPACE[buf], off)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    word = Spans(buf).hash(start, end)
    at = per_text(start, off)
    count = np.diff(at)
    # a running polynomial of five word hashes; the last words of a text have
    # fewer behind them and start no shingle
    h = np.zeros(len(word), np.uint64)
    for k in range(min(WORDS, len(word))):
        h[:len(word) - k] += word[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    h = mix(h)
    number = np.maximum(count - WORDS + 1, (count > 0).astype(np.int64))
    keep = np.arange(len(word)) < np.repeat(at[:-1] + number, count)
    for t in np.flatnonzero((count > 0) & (count < WORDS)).tolist():
        part = word[at[t]:at[t + 1]]
        h[at[t]] = mix(np.array([sum(int(w) * pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)
                                     for k, w in enumerate(part.tolist())) + len(part) & (1 << 64) - 1], np.uint64))[0]
    return h[keep], np.concatenate(([0], np.cumsum(number)))


def vectors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text, their counts and the offsets of the texts.
    Few shingles repeat, so only those that do are grouped."""
    h, at = shingles(buf, off)
    tf = np.ones(len(h), np.int64)
    seen = np.sort(h)
    again = seen[1:][seen[1:] == seen[:-1]]
    if len(again) == 0:
        return h, tf, at
    text = np.repeat(np.arange(len(off) - 1), np.diff(at))
    sub = np.flatnonzero(again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h)
    sub = sub[np.lexsort((h[sub], text[sub]))]
    x, t = h[sub], text[sub]
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (t[1:] != t[:-1]))))
    tf[sub] = 0
    tf[sub[new]] = np.diff(np.append(new, len(sub)))
    keep = tf > 0
    return h[keep], tf[keep], np.searchsorted(text[keep], np.arange(len(off)))


class Weights:
    """idf of shingles: a sorted table of the frequent ones, 2 for all others."""

    def __init__(self, n_docs: int, keys: np.ndarray, df: np.ndarray, saturate: int = SATURATE):
        order = np.argsort(keys)
        self.keys = keys[order]
        floor = max(2.0, n_docs / saturate)
        scale = math.log(saturate)

        def idf(x):
            return 1 + np.maximum(0.0, np.log(max(n_docs, 1) / np.maximum(x, floor))) / scale
        self.idf = idf(df[order].astype(np.float64))
        self.rest = float(idf(np.array([floor]))[0])

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = np.full(len(h), self.rest)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[i] == h
            w[hit] = self.idf[i[hit]]
        return w * tf


# --- consistent weighted sampling -------------------------------------------

def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 draws each of r and c (gamma law of shape 2) and of beta
    (uniform); a shingle and sample number index them."""
    held = process_memory()
    if "draws" not in held:
        rng = np.random.default_rng(20240607)
        u = 1 - rng.random((4, 1 << 16))
        held["draws"] = ((-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32),
                         rng.random(1 << 16).astype(np.float32))
    return held["draws"]


def sample(h: np.ndarray, weight: np.ndarray, at: np.ndarray, samples: int) -> np.ndarray:
    """(texts, samples) array of chosen (shingle, t) as hashes; texts without a
    shingle get zeros.  ln a = ln c - ln y - r with t = floor(ln w / r + beta),
    ln y = r (t - beta); the least a is chosen.  Most shingles have one and the
    same weight; what depends on r, beta and that weight is looked up."""
    out = np.zeros((len(at) - 1, samples), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full) == 0:
        return out
    first = at[full]
    r_of, c_of, beta_of = _draws()
    usual = np.float32(np.log(weight.max() if len(weight) < 3 else np.median(weight[:: max(1, len(weight) // 999)])))
    ln_w = np.log(weight).astype(np.float32)
    odd = np.flatnonzero(ln_w != usual)
    t_usual = np.floor(usual / r_of + beta_of)
    g_usual = r_of * (t_usual - beta_of) + r_of
    c_up = c_of + np.float32(64)  # positive floats have ordered bits
    seat = np.arange(len(h), dtype=np.uint64)
    x, y = np.empty_like(h), np.empty_like(h)
    for k in range(samples):
        np.multiply(h, np.uint64(pow(0xBF58476D1CE4E5B9, 2 * k + 1, 1 << 64)), out=x)
        np.right_shift(x, np.uint64(29), out=y)
        x ^= y
        x *= np.uint64(0x94D049BB133111EB)
        one, two = x.view(np.uint16)[3::4], x.view(np.uint16)[2::4]
        ln_a = c_up[two] - g_usual[one]
        if len(odd):
            o = one[odd]
            t = np.floor(ln_w[odd] / r_of[o] + beta_of[o])
            ln_a[odd] = c_up[two[odd]] - (r_of[o] * (t - beta_of[o]) + r_of[o])
        np.left_shift(ln_a.view(np.uint32), np.uint64(32), out=y, casting="unsafe", dtype=np.uint64)
        y |= seat
        best = (np.minimum.reduceat(y, first) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        o = one[best]
        t = np.floor(ln_w[best] / r_of[o] + beta_of[o]).astype(np.int64)
        out[full, k] = mix(h[best] + t.astype(np.uint64) * _STEP)
    return out


def band_keys(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(samples), samples.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        for r in range(rows):
            out[:, b] = mix(out[:, b] * np.uint64(3) + samples[:, b * rows + r])
        out[:, b] = mix(out[:, b] + np.uint64(b + 1))
    return out


# --- corpus statistics ------------------------------------------------------

def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's cell counts, as slices of the sketch."""
    count = np.zeros(CELLS, np.int64)
    n = 0
    for batch in batches:
        for i, j, buf, off in slices(batch.column("text"), SLICE):
            count += np.bincount(_cell(shingles(buf, off)[0]), minlength=CELLS)
            n += j - i
    if n:
        step = CELLS // 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(64, dtype=np.int32)), pa.array([n] + [0] * 63, pa.int64()),
             pa.array([count[k * step:(k + 1) * step].astype("<u4").tobytes() for k in range(64)], pa.binary())],
            names=["slice", "docs", "cells"])


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that came to this task (64 kinds at most)."""
    total: dict[int, np.ndarray] = {}
    docs: dict[int, int] = {}
    for b in batches:
        for k, n, x in zip(b.column("slice").to_pylist(), b.column("docs").to_pylist(), b.column("cells")):
            if k not in total:
                total[k], docs[k] = np.zeros(CELLS // 64, np.int64), 0
            total[k] += np.frombuffer(x.as_buffer(), "<u4")
            docs[k] += n
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(docs.values()), pa.int64()),
             pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())],
            names=["slice", "docs", "cells"])


def _in_full_cells(full: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, df = [], []
        def emit():
            keys, back = np.unique(np.concatenate(seen), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.bincount(back, np.concatenate(df)).astype(np.int64))],
                names=["h", "df"])
        held = 0
        for batch in batches:
            for _, _, buf, off in slices(batch.column("text"), SLICE):
                h, at = shingles(buf, off)
                some = full[_cell(h)]
                text = np.repeat(np.arange(len(off) - 1), np.diff(at))[some]
                h = h[some]
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                once = np.ones(len(h), bool)  # one per text
                once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                keys, n = np.unique(h[once], return_counts=True)
                seen.append(keys)
                df.append(n)
                held += len(keys)
                if held > 2_000_000:
                    yield emit()
                    seen, df, held = [], [], 0
        if held:
            yield emit()
    return run


def fit_weights(texts: DataFrame, saturate: int = SATURATE) -> Weights:
    """Document frequencies of the frequent shingles over all ``texts``."""
    kind = "slice int, docs long, cells binary"
    cells = texts.select("text").mapInArrow(_sketch, kind).repartition(64, "slice").mapInArrow(_add_slices, kind)
    rows = sorted(cells.collect(), key=lambda x: x["slice"])  # 64 rows of fixed size
    n = sum(x["docs"] for x in rows)
    floor = max(2.0, n / saturate)
    if not rows:
        return Weights(0, np.zeros(0, np.uint64), np.zeros(0))
    full = np.concatenate([np.frombuffer(x["cells"], "<i8") for x in rows]) > floor
    # at most saturate x (mean shingles per document) rows, by the floor
    often = texts.select("text").mapInArrow(_in_full_cells(full), "h long, df long").groupBy("h").agg(
        F.sum("df").alias("df")).filter(F.col("df") > floor).toPandas()
    return Weights(n, often["h"].to_numpy(np.int64).view(np.uint64), often["df"].to_numpy(np.float64), saturate)


# --- signatures and verification --------------------------------------------

def _signatures(weights: Weights, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text"), SLICE):
                h, tf, at = vectors(buf, off)
                w = weights(h, tf)
                keys = band_keys(sample(h, w, at, bands * rows), rows)
                total = np.add.reduceat(np.append(w, 0.0), at[:-1])
                total[np.diff(at) == 0] = 0.0
                same = mix(np.add.reduceat(np.append(mix(h + tf.astype(np.uint64) * _STEP), np.uint64(0)), at[:-1]))
                flat = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands,
                                                pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").slice(i, j - i), batch.column("doc_id").slice(i, j - i),
                     pa.array(np.diff(at) > 0), pa.array(same.view(np.int64)), pa.array(total), flat],
                    names=["row_key", "doc_id", "has", "same", "total", "bands"])
    return run


def similarity(a: tuple, b: tuple, weights: Weights) -> float:
    """Weighted Jaccard of two (sorted shingles, counts)."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = weights(*a), weights(*b)
    both = float(np.minimum(wa[i], wb[j]).sum())
    whole_ = float(wa.sum() + wb.sum()) - both
    return both / whole_ if whole_ else 0.0


def _verify(weights: Weights, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                parts = []
                for _, _, buf, off in slices(batch.column(name), SLICE):
                    h, tf, at = vectors(buf, off)
                    parts += [(h[x:y], tf[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                sides.append(parts)
            ok = [similarity(x, y, weights) >= threshold for x, y in zip(*sides)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row key; rows equal in both are one."""
    text = whole(F.col("text"))
    ident = F.col("doc_id").cast("long")
    return docs.select(ident.alias("doc_id"), text.alias("text"), F.xxhash64(ident, text).alias("row_key"))


def _links(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of row keys whose similarity reaches the threshold.  A
    leader with very many partners is spread over salts."""
    pairs = stored(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16))), "near-pairs")
    salts = pairs.groupBy(F.col("a").alias("row_key")).agg(F.collect_set("salt").alias("salts"))
    texts_a = texts.join(salts, "row_key").select(F.col("row_key").alias("a"), F.explode("salts").alias("salt"),
                                                  F.col("text").alias("text_a"))
    texts_b = texts.select(F.col("row_key").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(texts_b, "b").join(texts_a, ["a", "salt"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(weights, threshold), "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """row_key, label: the smallest key reachable over the links.  Labels move
    to neighbours until nothing changes; from the fourth round on they also
    jump to their label's label, so long chains take few rounds."""
    both = stored(links.select("a", "b").union(links.select("b", "a")), "near-links")
    labels = stored(both.groupBy(F.col("a").alias("row_key")).agg(F.least(F.col("row_key"), F.min("b")).alias("label")),
                    "near-labels")
    rounds = 0
    while True:
        rounds += 1
        said = both.join(labels.select(F.col("row_key").alias("b"), "label"), "b").select(
            F.col("a").alias("row_key"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("row_key", "label", F.col("label").alias("old"))
        nxt = said.union(own).groupBy("row_key").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        if rounds > 3:
            nxt = stored(nxt, "near-labels")
            jump = nxt.select(F.col("row_key").alias("label"), F.col("label").alias("far"))
            nxt = nxt.join(jump, "label", "left").select("row_key", F.coalesce("far", "label").alias("label"), "old")
        nxt = stored(nxt, "near-labels")
        labels = nxt.select("row_key", "label")
        if nxt.filter("label != old").isEmpty():
            break
    return nodes.join(labels, "row_key", "left").withColumn("label", F.coalesce("label", "row_key"))


def _query_blocks(weights: Weights, threshold: float):
    """Links of a bucket's queries to members of other classes; a pair counts
    in the first band it shares.  One link per query and class."""
    def unpack(rows: list[dict]):
        hs, tfs = [], []
        for _, _, buf, off in slices(pa.array([r["text"] for r in rows], pa.string()), SLICE):
            h, tf, at = vectors(buf, off)
            hs += [h[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            tfs += [tf[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        bands = np.array([r["bands"] for r in rows], np.int64)
        return hs, tfs, bands, np.array([r["row_key"] for r in rows], np.int64), np.array(
            [r["label"] for r in rows], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band = batch.column("band")[i].as_py()
                q_h, q_tf, q_bands, q_key, q_label = unpack(batch.column("queries")[i].as_py())
                h, tf, bands, key, label = unpack(batch.column("members")[i].as_py())
                size = np.array([len(x) for x in h])
                owner = np.repeat(np.arange(len(h)), size)
                flat = np.concatenate(h)
                w = weights(flat, np.concatenate(tf))
                total = np.bincount(owner, w, len(h))
                order = np.argsort(flat)
                flat, w, owner = flat[order], w[order], owner[order]
                a, b = [], []
                for j in range(len(q_h)):
                    meet = (label != q_label[j]) & ~(bands[:, :band] == q_bands[j, :band]).any(axis=1)
                    if not meet.any():
                        continue
                    own = weights(q_h[j], q_tf[j])
                    lo, hi = np.searchsorted(flat, q_h[j], "left"), np.searchsorted(flat, q_h[j], "right")
                    seat = gather(np.arange(len(flat)), lo, hi - lo)
                    both = np.bincount(owner[seat], np.minimum(np.repeat(own, hi - lo), w[seat]), len(h))
                    near = meet & (both >= threshold * (own.sum() + total - both))
                    if near.any():
                        _, one = np.unique(label[near], return_index=True)
                        b += key[near][one].tolist()
                        a += [int(q_key[j])] * len(one)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                     names=["a", "b"])
    return run


def _between_classes(buckets: DataFrame, labels: DataFrame, texts: DataFrame, weights: Weights,
                     threshold: float) -> DataFrame:
    """Links (a, b) between different classes inside the buckets that hold
    several."""
    part = buckets.select("band", "key", "row_key").join(labels, "row_key")
    several = part.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    several = several.filter("classes > 1").select("band", "key", F.col("top.label").alias("top"), "n",
                                                   (F.col("n") - F.col("top.n")).alias("outside"))
    mixed = stored(part.join(several, ["band", "key"]), "near-mixed")
    carried = mixed.join(texts, "row_key")
    who = F.struct("row_key", "label", "bands", "text")

    def blocks(rows: DataFrame, n: str, most: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("row_key", F.lit(name)), F.ceil(F.col(n) / most))
        return rows.groupBy("band", "key", block.alias("block")).agg(F.collect_list(who).alias(name)).drop("block")
    members = blocks(carried, "n", MEMBER_BLOCK, "members")
    queries = blocks(carried.filter("label != top"), "outside", QUERY_BLOCK, "queries")
    return queries.join(members, ["band", "key"]).select("band", "queries", "members").mapInArrow(
        _query_blocks(weights, threshold), "a long, b long")


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """row_key, doc_id, label per row."""
    texts = _keyed(docs)
    weights = fit_weights(texts)
    sig = stored(texts.select("row_key", "doc_id", "text").mapInArrow(
        _signatures(weights, bands, rows),
        "row_key long, doc_id long, has boolean, same long, total double, bands array<bigint>"), "near-signatures")
    # texts of one shingle bag are one: the smallest row key stands for them
    reps = stored(sig.filter("has").groupBy("same").agg(
        F.min_by(F.struct("row_key", "total", "bands"), F.col("row_key")).alias("r")).select("same", "r.*"),
        "near-reps")
    members = reps.select("row_key", "total", F.posexplode("bands").alias("band", "key"))
    several = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = stored(members.join(several, ["band", "key"]), "near-buckets")
    degree = buckets.groupBy("row_key").agg(F.sum("n").alias("degree"))
    first = buckets.join(degree, "row_key").groupBy("band", "key").agg(
        F.max(F.struct("degree", "row_key", "total")).alias("lead"))
    # weighted Jaccard is at most the ratio of the weight sums
    near = F.least("total", "total_a") >= threshold * F.greatest("total", "total_a") * (1 - 1e-9)
    pairs = buckets.join(first, ["band", "key"]).select(
        F.col("lead.row_key").alias("a"), F.col("row_key").alias("b"), "total", F.col("lead.total").alias("total_a"))
    pairs = pairs.filter((F.col("a") != F.col("b")) & near).select("a", "b").distinct()
    # the only texts that travel: those of bucket members
    texts = texts.join(degree, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", "text")
    texts = stored(texts, "near-texts")
    links = stored(_links(pairs, texts, weights, threshold), "near-found")
    labels = stored(components(reps.select("row_key"), links), "near-classes")
    full = texts.join(reps.select("row_key", "bands"), "row_key")
    found = stored(_between_classes(buckets, labels, full, weights, threshold), "near-found")
    if not found.isEmpty():
        labels = stored(components(reps.select("row_key"), links.union(found)), "near-classes")
    of_bag = reps.select("same", "row_key").join(labels, "row_key").select("same", "label")
    return sig.select("row_key", "doc_id", "has", "same").join(of_bag, "same", "left").select(
        "row_key", "doc_id", F.when(F.col("has"), F.col("label")).otherwise(F.col("row_key")).alias("label"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size for every row."""
    found = stored(_classes(docs, threshold, bands, rows), "near-rows")
    ids = found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(ids, "label").select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS,
                         rows: int = ROWS) -> DataFrame:
    """One document of each class (the smallest doc_id) with all its columns."""
    found = _classes(docs, threshold, bands, rows).dropDuplicates(["row_key"])
    first = stored(found.groupBy("label").agg(
        F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("near_key")), "near-first")
    ident = F.col("doc_id").cast("long")
    text = whole(F.col("text"))
    keyed = docs.select(F.xxhash64(ident, text).alias("near_key"), F.md5(text).alias("near_text"), ident.alias("near_id"),
                        F.struct("*").alias("near_doc"))
    kept = keyed.join(first.select("near_key"), "near_key", "left_semi")
    once = F.row_number().over(Window.partitionBy("near_key", "near_id", "near_text").orderBy("near_key"))
    return kept.select("near_doc", once.alias("near_row")).filter("near_row = 1").select("near_doc.*")
