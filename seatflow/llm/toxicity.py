"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max
inverted index, distance-weighted votes, calibrated scores with evidence.

Terms are words (letters and digits, ASCII case folded) and their beginnings
of 4 to 7 bytes, so that words formed from one stem meet.  A vector is a text's
unit vector of (1 + ln tf) * idf, with document frequencies over all documents.
An example is a labelled document with all of its terms; a scored document's
vector is over all terms that any example has: others match nothing and are left
out of its length too, which scales its cosines but keeps their order.

The index holds, per term, the examples' weights (in single precision) in blocks of ``BLOCK``
examples and each block's largest weight.  Examples that use the same words lie
in the same blocks.  Terms of many examples are multiplied for all examples at once; a
document adds each block's best of those sums and the block maxima of its other
terms: no example of a block can score higher.  Blocks are opened from the highest bound
down, then only where the bound reaches the k-th best score less the most that single
precision can be off.  The examples that may be among the k nearest are then summed again in
double precision, so the k nearest are exact.  ``TOGETHER`` documents are searched at a time, in the
same few array steps.  They vote with weight 1 / (1 - cosine + EASE); the vote is mapped to a
probability by a monotone step function, fitted on the sample with each
document left out of its own neighbours.

Sample and examples have documented bounds (``FIT_ROWS``, ``EXAMPLES`` per
class); everything else covers all documents.
Defined cases: a document without any term of an example (an empty or null
text, for instance) has no neighbours and gets the share of toxic documents among
such sample documents; without labels every score is 0; repeated rows are
scored each; a very long text is read whole, as a slice of its own; of examples with equal
cosines (nine places) the one that comes first in the index counts; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import held_out, stored
from seatflow.llm.samples import labelled_sample
from seatflow.llm.textvec import Spans, _BYTE, per_text, runs, slices

FIT_ROWS = 20_000
EXAMPLES = 2_000
NEAREST = 15
EASE = 0.05
BLOCK = 64
GROUPS = 16
FREQUENT, FREQUENT_SHARE, TOGETHER, AT_ONCE = 4096, 256, 256, 32
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7
SLICE = 1 << 19
_FILTER = 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(buf: np.ndarray, off: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term; with ``known`` (a filter by the
    low bits of the hash) only of those that may be in the vocabulary."""
    start, end = runs(_IN_WORD[buf], off)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spans = Spans(buf, _BYTE[_FOLD])
    text = np.repeat(np.arange(len(off) - 1), np.diff(per_text(start, off)))
    hs, ts = [], []
    for n in (0, *STEMS):
        if n:
            long = end - start > n
            h, t = spans.hash(start[long], start[long] + n) ^ np.uint64(n * 0x9E3779B1), text[long]
        else:
            h, t = spans.hash(start, end), text
        if known is not None:
            some = known[(h & np.uint64((1 << _FILTER) - 1)).astype(np.int64)]
            h, t = h[some], t[some]
        hs.append(h)
        ts.append(t)
    return np.concatenate(hs), np.concatenate(ts)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then from start[1] on, and so forth."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)


# --- index ------------------------------------------------------------------

class Index:
    """Vocabulary and block-max postings of the examples."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray):
        order = np.argsort(vocabulary)
        self.words, self.idf, self.first = vocabulary[order], idf[order], None
        self.known = np.zeros(1 << _FILTER, bool)
        self.known[(self.words & np.uint64((1 << _FILTER) - 1)).astype(np.int64)] = True
        self.steps, self.values, self.without = np.zeros(0), np.zeros(1), 0.0
        self.add(np.zeros(0, np.int64), np.zeros(0, np.int64), [])

    def counts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, term number) in order, with counts."""
        h, t = terms(buf, off, self.known)
        at = self._find(h)
        hit = at >= 0
        size = max(1, len(self.words))
        pair, tf = np.unique(t[hit] * size + at[hit], return_counts=True)
        return pair // size, pair % size, tf

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where it is none.  A table by the hash's
        first bits leads to the few terms that share them."""
        if self.first is None:
            edges = np.arange(1 << _FILTER, dtype=np.uint64) << np.uint64(64 - _FILTER)
            self.first = np.append(np.searchsorted(self.words, edges), len(self.words))
        bits = (h >> np.uint64(64 - _FILTER)).astype(np.int64)
        out, at, end = np.full(len(h), -1, np.int64), self.first[bits], self.first[bits + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.words[at[left]] == h[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def vectors(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit vector of each text: term numbers and weights."""
        return self.weighted(*self.counts(buf, off), len(off) - 1)

    def weighted(self, t: np.ndarray, at: np.ndarray, tf: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        w = (1 + np.log(tf)) * self.idf[at]
        edges = np.searchsorted(t, np.arange(n + 1))
        norm = np.sqrt(np.add.reduceat(np.append(w * w, 0.0), edges[:-1])) if n else w
        return [(at[a:b], w[a:b] / m if b > a else w[a:b]) for a, b, m in
                zip(edges[:-1].tolist(), edges[1:].tolist(), norm.tolist())]

    def add(self, ids: np.ndarray, y: np.ndarray, vecs: list) -> None:
        """Build the postings, term by term and block by block."""
        self.ids, self.y = ids, y
        self.blocks = -(-len(ids) // BLOCK)
        n = [len(v[0]) for v in vecs]
        term = np.concatenate([v[0] for v in vecs]) if vecs else np.zeros(0, np.int64)
        w = np.concatenate([v[1] for v in vecs]) if vecs else np.zeros(0)
        doc = np.repeat(np.arange(len(vecs)), n)
        order = np.lexsort((doc, term))
        # weights in single precision: what is summed of them below is the index's own weight, not a rounded copy
        self.post_doc, self.post_w = doc[order].astype(np.min_scalar_type(len(ids))), w[order].astype(np.float32)
        self.df = np.bincount(term, minlength=len(self.words))
        self.dense = None

    def __getstate__(self) -> dict:
        """Postings only: blocks and sums are made where they are used, not sent."""
        return {k: getattr(self, k) for k in ("words", "idf", "known", "steps", "values", "without", "ids", "y", "blocks",
                                              "post_doc", "post_w", "df")} | {"dense": None, "first": None}

    def _arrange(self) -> None:
        """Blocks of every term's postings, and each example's weights of the frequent terms."""
        term = np.repeat(np.arange(len(self.df)), self.df)
        cell = term * max(1, self.blocks) + self.post_doc // BLOCK
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        self.cell_block = (self.post_doc // BLOCK)[new].astype(np.int32) if len(cell) else new.astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.post_w, new) if len(cell) else np.zeros(0, np.float32)
        self.cell_posts = np.append(new, len(cell))
        self.term_cells = np.searchsorted(term[new], np.arange(len(self.words) + 1))
        often = np.argsort(-self.df, kind="stable")[:FREQUENT]
        self.often = often[self.df[often] * FREQUENT_SHARE > len(self.ids)]
        self.row = np.full(len(self.words) + 1, -1, np.int32)
        self.row[self.often] = np.arange(len(self.often))
        self.dense = np.zeros((self.blocks * BLOCK, len(self.often)), np.float32)
        at = self.row[term]
        self.dense[self.post_doc[at >= 0], at[at >= 0]] = self.post_w[at >= 0]

    def _frequent(self, vecs: list) -> np.ndarray:
        """Each vector's weights of the frequent terms."""
        if self.dense is None:
            self._arrange()
        q = np.zeros((len(vecs), len(self.often)))
        for k, (t, w) in enumerate(vecs):
            row = self.row[t]
            q[k, row[row >= 0]] = w[row >= 0]
        return q

    def _opened(self, cell: np.ndarray, at: np.ndarray, w: np.ndarray, m: int) -> np.ndarray:
        """Sums of weight ``w`` times the postings of each cell, for ``m`` vectors; ``at`` is where a vector's sums begin."""
        start, end = self.cell_posts[cell], self.cell_posts[cell + 1]
        n = end - start
        run = np.repeat(np.arange(len(cell)), n)
        post = (end - np.cumsum(n))[run] + np.arange(len(run))
        width = self.blocks * BLOCK
        return np.bincount(at[run] + self.post_doc[post], w[run] * self.post_w[post], m * width).reshape(m, width)

    def _scores(self, vecs: list, base: np.ndarray, k: int, skip: list
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each vector's examples that may be among its k best, with their sums over
        the rare terms.  ``base`` has the products over the frequent terms in
        single precision; with ``slack``, more than they can be off, no example
        is missed.  The blocks of the highest bounds are opened first, then
        those whose bound reaches the k-th best score of these: postings of
        other blocks are not read."""
        m, blocks = len(vecs), self.blocks
        width = blocks * BLOCK
        left_out = [(r, x) for r, x in enumerate(skip) if x is not None]
        for r, x in left_out:
            base[r, x] = 0.0
        # each of n nonnegative products and sums is off by 2 ** -24 of itself at most, the whole by about n times that
        slack = np.array([len(v[0]) + 8 for v in vecs]) * 2.0 ** -22
        text = np.repeat(np.arange(m), [len(v[0]) for v in vecs])
        t, w = (np.concatenate([v[c] for v in vecs]) for c in (0, 1))
        rare = np.flatnonzero(self.row[t] < 0)
        # term by term, so that vectors with a term in common read its cells and postings one after the other
        rare = rare[np.argsort(t[rare], kind="stable")]
        text, t, w = text[rare], t[rare], w[rare]
        n = self.term_cells[t + 1] - self.term_cells[t]
        cell, w = spread(self.term_cells[t], n), np.repeat(w, n)
        place = np.repeat(text * blocks, n) + self.cell_block[cell]
        tops = base.reshape(m, blocks, BLOCK)
        bound = tops.max(axis=2) + np.bincount(place, w * self.cell_max[cell], m * blocks).reshape(m, blocks)
        at = np.repeat(text * width, n)
        first = min(blocks, blocks // 16 + 1)
        best = np.argpartition(bound, blocks - first, axis=1)[:, blocks - first:]
        rows, least = np.arange(m)[:, None], np.zeros(m)
        todo = np.zeros((m, blocks), bool)
        todo[rows, best] = True
        own = np.flatnonzero(todo.ravel()[place])
        rest = self._opened(cell[own], at[own], w[own], m)
        for r, x in left_out:
            rest[r, x] = 0.0
        if first * BLOCK >= k:
            score = (tops[rows, best] + rest.reshape(m, blocks, BLOCK)[rows, best]).reshape(m, first * BLOCK)
            least = np.partition(score, first * BLOCK - k, axis=1)[:, first * BLOCK - k]
        least = least - slack
        todo = ~todo & (bound > 0) & (bound >= least[:, None])
        own = np.flatnonzero(todo.ravel()[place])
        rest += self._opened(cell[own], at[own], w[own], m)
        for r, x in left_out:
            rest[r, x] = 0.0
        # an example of a block left closed has less than ``least`` here, too
        score = base + rest
        may = (score > 0) & (score >= least[:, None])
        for r in range(m):
            found = np.flatnonzero(may[r])
            if len(found) > k:
                own = score[r, found]
                found = found[own >= np.partition(own, len(own) - k)[len(own) - k] - slack[r]]
            yield found, rest[r, found]

    def nearest(self, vecs: list, k: int, skip: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The k nearest examples of each vector (numbers and cosines), ties by
        number; ``skip`` names an example per vector that doesn't count."""
        skip = skip or [None] * len(vecs)
        together = -(-len(vecs) // max(1, -(-len(vecs) // TOGETHER)))  # groups of even size
        for i in range(0, len(vecs), max(1, together)):
            group = vecs[i:i + together]
            if not self.blocks:
                yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in group)
                continue
            q = self._frequent(group)
            # the examples' rows as they lie in memory: a product of the large matrix from the left is the faster one
            base = np.ascontiguousarray((self.dense @ q.astype(np.float32).T).T)
            for j in range(0, len(base), AT_ONCE):
                some = slice(j, j + AT_ONCE)
                own = skip[i:i + together][some]
                for r, (found, rest) in enumerate(self._scores(group[some], base[some], k, own)):
                    score = rest + self.dense[found].astype(np.float64) @ q[j + r]
                    best = np.lexsort((found, -np.round(score, 9)))[:k]
                    yield found[best], score[best]

    def votes(self, vecs: list, skip: list | None = None) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """Vote, nearest examples and cosines of each vector."""
        for near, cos in self.nearest(vecs, NEAREST, skip):
            if len(near) == 0:
                yield None, near, cos
                continue
            w = 1 / (np.maximum(0.0, 1 - cos) + EASE)
            # a text far from every example leans on what it is near to, not on chance
            yield float((w * self.y[near]).sum() / w.sum()), near, cos

    def calibrate(self, votes: list[float | None], y: list[int], weight: list[float]) -> None:
        """Monotone step function from vote to probability (pool adjacent violators)."""
        lone = [(t, w) for v, t, w in zip(votes, y, weight) if v is None]
        self.without = sum(t * w for t, w in lone) / sum(w for _, w in lone) if lone else 0.0
        rows = sorted((v, t, w) for v, t, w in zip(votes, y, weight) if v is not None)
        pools: list[list[float]] = []  # least vote, sum, weight
        for v, t, w in rows:
            if pools and pools[-1][3] == v:
                pools[-1][1] += t * w
                pools[-1][2] += w
            else:
                pools.append([v, t * w, w, v])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1][1] += last[1]
                pools[-1][2] += last[2]
                pools[-1][3] = last[3]
        if pools:
            self.steps = np.array([p[0] for p in pools[1:]])
            self.values = np.array([p[1] / p[2] for p in pools])

    def probability(self, vote: float | None) -> float:
        if vote is None:
            return self.without
        return float(self.values[int(np.searchsorted(self.steps, vote, "right"))])


# --- fitting ----------------------------------------------------------------

def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each text with counts, as lists."""
    for batch in batches:
        for i, j, buf, off in slices(batch.column("text"), SLICE):
            h, t = terms(buf, off)
            order = np.lexsort((h, t))
            h, t = h[order], t[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))[:len(h)])
            edges = pa.array(np.searchsorted(t[new], np.arange(j - i + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in
                     (h[new].view(np.int64), np.diff(np.append(new, len(h))))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("y").slice(i, j - i),
                                              *lists], names=["doc_id", "y", "terms", "tf"])


def _document_counts(index: Index):
    """Number of documents with each of the index's terms, per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(index.words), np.int64)
        for batch in batches:
            for _, _, buf, off in slices(batch.column("text"), SLICE):
                df += np.bincount(index.counts(buf, off)[1], minlength=len(df))
        some = np.flatnonzero(df)
        for i in range(0, len(some), 10_000):
            part = some[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(df[part])], names=["term", "df"])
    return run


def _votes(index: Index):
    number = dict(zip(index.ids.tolist(), range(len(index.ids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text"), SLICE):
                ids = batch.column("doc_id").slice(i, j - i)
                vecs = index.vectors(buf, off)
                votes = [v[0] for v in index.votes(vecs, [number.get(x) for x in ids.to_pylist()])]
                yield pa.RecordBatch.from_arrays([ids, batch.column("y").slice(i, j - i), pa.array(votes, pa.float64())],
                                                 names=["doc_id", "y", "vote"])
    return run


def _alike(vecs: list, terms: int) -> np.ndarray:
    """An order of the vectors in which those of common words are together:
    groups about ``GROUPS`` centres, moved a few times."""
    n = len(vecs)
    if n <= BLOCK:
        return np.arange(n)
    term, w = np.concatenate([v[0] for v in vecs]), np.concatenate([v[1] for v in vecs])
    doc = np.repeat(np.arange(n), [len(v[0]) for v in vecs])
    centres = [np.bincount(vecs[i][0], vecs[i][1], terms) for i in range(0, n, -(-n // GROUPS))]
    for _ in range(4):
        near = np.argmax([np.bincount(doc, w * c[term], n) for c in centres], axis=0)
        for g in range(len(centres)):
            own = (near == g)[doc]
            c = np.bincount(term[own], w[own], terms)
            centres[g] = c / max(1e-12, float(np.linalg.norm(c)))
    return np.argsort(near, kind="stable")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS,
        examples: int = EXAMPLES) -> Index:
    """Examples and calibration from the bounded sample, document frequencies
    of all the examples' terms from all documents."""
    sample = stored(labelled_sample(docs, labels, label, fit_rows).repartition(32, "doc_id"), "toxicity-sample")
    key = F.shiftright(F.xxhash64("doc_id"), 32)
    words = sample.filter(F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")).select("doc_id", "y")
    chosen = None
    for y in (1, 0):
        part = words.filter(F.col("y") == y).orderBy(key, "doc_id").limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    # bounded: at most ``examples`` documents of either class
    rows = sample.join(F.broadcast(chosen.select("doc_id")), "doc_id").mapInArrow(
        _terms_of, "doc_id long, y int, terms array<long>, tf array<long>").toArrow().sort_by("doc_id")
    lists = [rows.column(c).combine_chunks() for c in ("terms", "tf")]
    h, tf = (np.asarray(x.flatten()) for x in lists)
    doc = np.repeat(np.arange(len(rows)), np.asarray(lists[0].value_lengths(), np.int64))
    known, at = np.unique(h.view(np.uint64), return_inverse=True)
    index = Index(known, np.zeros(len(known)))
    n, df = docs.count(), np.zeros(len(known))
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _document_counts(index), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[np.asarray(counted.column("term"), np.int64)] = np.asarray(counted.column("df"), np.float64)
    index.idf = np.log((1 + n) / (1 + df)) + 1
    order = np.lexsort((at, doc))
    vecs = index.weighted(doc[order], at[order], tf[order], len(rows))
    del lists, h, tf, doc, at, order, counted
    order = _alike(vecs, len(known))
    index.add(np.asarray(rows.column("doc_id"), np.int64)[order], np.asarray(rows.column("y"), np.int64)[order],
              [vecs[i] for i in order.tolist()])
    del rows, vecs
    # at most ``fit_rows`` short rows
    votes = sample.select("doc_id", "y", "text").mapInArrow(_votes(index), "doc_id long, y int, vote double"
                                                            ).toArrow().sort_by("doc_id")
    index.calibrate(votes.column("vote").to_pylist(), votes.column("y").to_pylist(), [1.0] * len(votes))
    return index


# --- scoring ----------------------------------------------------------------

def _score(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text"), SLICE):
                score, ids, cosines = [], [], []
                vecs = index.vectors(buf, off)
                for vote, near, cos in index.votes(vecs):
                    score.append(index.probability(vote))
                    ids.append(index.ids[near[:3]].tolist() if len(near) else [])
                    cosines.append([round(x, 6) for x in cos[:3]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(score, pa.float64()),
                     pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                    names=["doc_id", "score", "evidence", "cosines"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, and the ids and cosines of the three
    nearest examples."""
    index = index or fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(index), "doc_id long, score double, evidence array<long>, cosines array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "cosines")
