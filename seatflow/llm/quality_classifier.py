"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network in numpy with temperature-calibrated probabilities.

Tokens are runs of letters and digits (case kept) and runs of ASCII
punctuation.  Each token hashes to one of ``TOKENS`` rows; its index vector
has two signed ones among ``DIMS`` places, given by its hash.  The word vector
of a token is the sum of the index vectors of its neighbours (two to each
side) over the **whole corpus**, damped (signed log) and scaled to length 1.
The table has a fixed size, so partial tables of the tasks add up and the sum
is sent to every task.

A document is the mean of its tokens' vectors and the mean over its distinct
tokens, with four pooled figures: mean cosine of tokens one and two places
apart (both means and cosines tell texts that repeat themselves), share of
distinct tokens, and log length.  A network with one hidden layer is
trained on a bounded sample of labelled documents (``FIT_ROWS``); a fifth of
them, chosen by hash, sets the temperature that makes the probabilities fit.

Defined cases: an empty or null text has zero vectors and is scored like any
other; without labels of both kinds every score is the share of label 1 (0.5
without any); repeated rows are scored each, and alike; a very long text is read whole, as a
slice of its own; a score of just the threshold counts as label 1; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import held_out, stored
from seatflow.llm.samples import labelled_sample
from seatflow.llm.textvec import Spans, mix, per_text, runs, slices

FIT_ROWS = 20_000
TOKENS = 1 << 14
DIMS = 32
WINDOW = 2
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.5
SLICE = 1 << 20
FEATURES = 2 * DIMS + 4
_PIECES = 16

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each token, in order."""
    a = runs(_LETTER[buf], off)
    b = runs(_MARK[buf], off)
    start, end = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(per_text(start, off)))
    return Spans(buf).hash(start, end), text


def _row(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TOKENS - 1)).astype(np.int64)


def contexts(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Sum of neighbours' index vectors per token row."""
    out = np.zeros(TOKENS * DIMS)
    x = mix(h)
    row = _row(h) * DIMS
    for shift in (8, 24):
        place = ((x >> np.uint64(shift)) & np.uint64(DIMS - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((x >> np.uint64(shift + 12)) & np.uint64(1)).astype(np.float64)
        for d in range(1, WINDOW + 1):
            near = text[d:] == text[:-d]
            at = np.concatenate(((row[:-d] + place[d:])[near], (row[d:] + place[:-d])[near]))
            out += np.bincount(at, np.concatenate((sign[d:][near], sign[:-d][near])), TOKENS * DIMS)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, some = np.zeros(TOKENS * DIMS), False
    for batch in batches:
        for _, _, buf, off in slices(batch.column("text"), SLICE):
            total += contexts(*tokens(buf, off))
            some = True
    if some:
        parts = np.split(total.astype("<i4"), _PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PIECES, dtype=np.int32)),
                                          pa.array([p.tobytes() for p in parts], pa.binary())],
                                         names=["piece", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("piece").to_pylist(), batch.column("sums")):
            part = np.frombuffer(x.as_buffer(), "<i8" if len(x.as_buffer()) > TOKENS * DIMS // _PIECES * 4 else "<i4")
            total[k] = total.get(k, 0) + part.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())],
                                         names=["piece", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(TOKENS, DIMS) table over all documents."""
    kind = "piece int, sums binary"
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_contexts, kind).repartition(
        _PIECES, "piece").mapInArrow(_add, kind).collect()  # _PIECES rows of fixed size
    sums = np.zeros((_PIECES, TOKENS * DIMS // _PIECES), np.int64)
    for r in rows:
        sums[r["piece"]] = np.frombuffer(r["sums"], "<i8")
    table = sums.reshape(TOKENS, DIMS).astype(np.float64)
    table = np.sign(table) * np.log1p(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(texts, FEATURES): what a document is to the network."""
    n = len(off) - 1
    h, text = tokens(buf, off)
    out = np.zeros((n, FEATURES), np.float32)
    if len(h) == 0:
        return out
    row = _row(h)
    full, first, count = np.unique(text, return_index=True, return_counts=True)
    vec = table[row]
    out[full, :DIMS] = np.add.reduceat(vec, first) / count[:, None]
    for d in (1, 2):
        cos = np.zeros(len(row), np.float32)
        cos[d:] = np.einsum("ij,ij->i", vec[d:], vec[:-d]) * (text[d:] == text[:-d])
        out[full, 2 * DIMS + d - 1] = np.add.reduceat(cos, first) / count
    key = np.unique(text * TOKENS + row)
    vec, text = table[key % TOKENS], key // TOKENS
    first = np.searchsorted(text, full)
    distinct = np.diff(np.append(first, len(text)))
    out[full, DIMS:2 * DIMS] = np.add.reduceat(vec, first) / distinct[:, None]
    out[full, 2 * DIMS + 2] = distinct / count
    out[full, 2 * DIMS + 3] = np.log(count)
    return out


# --- network ----------------------------------------------------------------

class Network:
    """Standardised inputs, one hidden layer (tanh), one logit."""

    def __init__(self, share: float):
        self.share, self.layers, self.temperature = share, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))

    def train(self, x: np.ndarray, y: np.ndarray, hold: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS,
              seed: int = 7) -> Network:
        """Adam on the logistic loss over rows not held; temperature on the held."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x[~hold].mean(0), x[~hold].std(0) + 1e-3
        z, t = (x[~hold] - self.mean) / self.scale, y[~hold].astype(np.float64)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
             rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 64):
                a, b = z[order[i:i + 64]], t[order[i:i + 64]]
                hid = np.tanh(a @ p[0] + p[1])
                err = (1 / (1 + np.exp(-(hid @ p[2] + p[3]))) - b) / len(b)
                back = np.outer(err, p[2]) * (1 - hid ** 2)
                grads = [a.T @ back + 1e-4 * p[0], back.sum(0), hid.T @ err + 1e-4 * p[2], np.array([err.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.layers = p
        if hold.any():
            logit, t = self.logits(x[hold]), y[hold]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [float(np.logaddexp(0, np.where(t == 1, -1, 1) * logit / g).mean()) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def _pooled(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text"), SLICE):
                x = pooled(buf, off, table)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("y").slice(i, j - i),
                     pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], names=["doc_id", "y", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, label: str = "quality",
        fit_rows: int = FIT_ROWS) -> Network:
    """The network, from the bounded sample (at most ``fit_rows`` vectors)."""
    sample = stored(labelled_sample(docs, labels, label, fit_rows), "quality-sample")
    rows = sample.select("doc_id", "y", "text").mapInArrow(_pooled(table), "doc_id long, y int, x binary").toPandas()
    rows = rows.sort_values("doc_id")
    y = rows["y"].to_numpy(np.int64)
    net = Network(float(y.mean()) if len(y) else 0.5)
    if len(np.unique(y)) < 2:
        return net
    x = np.stack([np.frombuffer(b, "<f4") for b in rows["x"]]).astype(np.float64)
    hold = mix(rows["doc_id"].to_numpy(np.int64).view(np.uint64)) % np.uint64(5) == 0
    if hold.all() or len(np.unique(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
    return net.train(x, y, hold)


def _score(table: np.ndarray, net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text"), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i),
                     pa.array(net.probability(pooled(buf, off, table).astype(np.float64)))],
                    names=["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    table = word_vectors(docs)
    net = fit(docs, labels, table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(table, net), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
