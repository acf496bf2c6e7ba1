"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` ids; longer ones are cut into
whole pieces behind a shorter first one.  Whole pieces are sequences by
themselves.  The others are dealt into shards of about ``SHARD_ITEMS`` pieces;
every shard lives on several islands.  An island holds a few packings
(best-fit over descending lengths, and over disturbed orders) and crosses
them: well-filled bins of one parent are injected whole into the other, bins
that held the same pieces are dissolved, and the displaced pieces go best-fit,
longest first, into what is left.  After each epoch the elites move to the
next island of the ring.  Bins of a shard's best packing that are nearly full
are final; the pieces of the others meet pieces of other shards on the next
level, until one shard is left or a level has settled less than half.

A shard has a fixed expected size, so an island's memory is bounded at any
number of documents, and nothing but lengths and piece numbers moves in the
search: ids are written once and joined by piece number at the end.

Defined cases: a null text is empty and becomes one piece, the end id; rows
that repeat a doc_id are packed each; a null doc_id is carried; an empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatflow.llm.common import stored
from seatflow.llm.textvec import slices
from seatflow.llm.tokens import encoder, tokenizer_file
from seatflow.session import scratch_path

CAPACITY = 1024
END_ID = 2
SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CROSSINGS = 12
NEARLY_FULL = 0.985
WELL_FILLED = 0.995


# --- pieces -----------------------------------------------------------------

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            names = batch.column("doc_id").to_numpy(zero_copy_only=False)
            null = np.asarray(batch.column("doc_id").is_null())
            for i, j, buf, off in slices(batch.column("text")):
                flat, at = enc(buf, off)
                size = np.diff(at) + 1
                flat = np.insert(flat, at[1:], end_id)
                n_pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                head = size - (n_pieces - 1) * capacity  # the first piece may be shorter
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                edges = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [
                    None, pa.py_buffer(edges.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
                ids = pa.array(np.where(null[i:j], 0, names[i:j]).astype(np.int64)[doc], mask=null[i:j][doc])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw],
                    names=["doc_id", "piece", "start", "length", "ids"])
    return run


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID,
               capacity: int = CAPACITY) -> DataFrame:
    """piece_no, doc_id, piece, start, length and the ids (little-endian
    unsigned 32-bit), written once."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut(tokenizer or tokenizer_file(), end_id, capacity), _PIECES)
    rows.withColumn("piece_no", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


# --- one island -------------------------------------------------------------

def _best_fit(items: np.ndarray, size: np.ndarray, assign: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put items, in the given order, into the fullest bin that takes them.
    Bins by free room in a bit mask: the lowest set bit at or above the need."""
    room: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fill):
        if f < capacity:
            room.setdefault(capacity - f, []).append(b)
            mask |= 1 << (capacity - f)
    for i, need in zip(items.tolist(), size[items].tolist()):
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
            free -= need
        else:
            b, free = len(fill), capacity - need
            fill.append(0)
        assign[i] = b
        fill[b] = capacity - free
        if free:
            if not room.get(free):
                room[free] = []
                mask |= 1 << free
            room[free].append(b)


def _compact(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def best_fit_decreasing(size: np.ndarray, capacity: int, noise: float, rng) -> np.ndarray:
    order = np.argsort(-size * (1 + noise * rng.random(len(size))), kind="stable")
    assign = np.zeros(len(size), np.int32)
    _best_fit(order, size, assign, [], capacity)
    return assign


def cross(a: np.ndarray, b: np.ndarray, size: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Child of ``a`` with well-filled bins of ``b`` injected whole."""
    fill_b = np.bincount(b, size)
    good = np.flatnonzero(fill_b >= WELL_FILLED * capacity)
    if len(good) == 0:
        good = np.array([int(fill_b.argmax())])
    good = good[rng.random(len(good)) < rng.uniform(0.05, 0.3)]
    inject = np.isin(b, good)
    gone = np.zeros(int(a.max()) + 1, bool)
    gone[a[inject]] = True
    # the emptiest bins give way too, so that each child has pieces to place
    fill_a = np.bincount(a, size)
    gone[np.argsort(fill_a, kind="stable")[:max(2, len(fill_a) // 50)]] = True
    child = np.where(inject, len(gone) + b, a)
    loose = gone[a] & ~inject
    child[~loose] = _compact(child[~loose])
    fill = np.bincount(child[~loose], size[~loose]).astype(int).tolist() if (~loose).any() else []
    items = np.flatnonzero(loose)
    _best_fit(items[np.argsort(-size[items], kind="stable")], size, child, fill, capacity)
    return child.astype(np.int32)


def fitness(assign: np.ndarray, size: np.ndarray, capacity: int) -> float:
    """Fewer bins first, then uneven fill (full bins next to nearly empty ones)."""
    fill = np.bincount(assign, size) / capacity
    return -len(fill) + float((fill ** 2).mean())


def evolve(size: np.ndarray, seeds: list[np.ndarray], capacity: int, seed: int,
           population: int = POPULATION, crossings: int = CROSSINGS) -> list[np.ndarray]:
    """The island's packings after its crossings, best first."""
    rng = np.random.default_rng(seed)
    pop = [s.astype(np.int32) for s in seeds]
    while len(pop) < population:
        pop.append(best_fit_decreasing(size, capacity, 0.0 if not pop else 0.15, rng))
    pop = sorted(((fitness(p, size, capacity), i, p) for i, p in enumerate(pop)), reverse=True, key=lambda x: x[:2])
    least = -(-int(size.sum()) // capacity)
    for step in range(crossings):
        if pop[0][2].max() + 1 <= least:
            break
        i, j = rng.choice(len(pop), 2, replace=False)
        child = cross(pop[i][2], pop[j][2], size, capacity, rng)
        score = fitness(child, size, capacity)
        if score > pop[-1][0]:
            pop[-1] = (score, len(pop) + step, child)
            pop.sort(reverse=True, key=lambda x: x[:2])
    return [p for _, _, p in pop]


# --- islands on Spark -------------------------------------------------------

def _epoch(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                size = np.asarray(row.sizes, np.int64)
                elites = [np.asarray(e, np.int32) for e in (row.elites if row.elites is not None else ())]
                best = evolve(size, elites, capacity, (row.shard * 31 + row.island) * 31 + epoch)[:2]
                yield pd.DataFrame({"shard": [row.shard], "island": [row.island], "sizes": [row.sizes],
                                    "numbers": [row.numbers], "score": [fitness(best[0], size, capacity)],
                                    "elites": [[e.tolist() for e in best]]})
    return run


def _settle(capacity: int, nearly_full: float):
    """Best packing of each shard to rows; ``done`` marks the final bins."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                size, assign = np.asarray(row.sizes, np.int64), np.asarray(row.best, np.int64)
                order = np.argsort(assign, kind="stable")
                fill = np.bincount(assign, size)
                ends = np.cumsum(size[order])
                first = np.concatenate(([0], np.cumsum(fill)[:-1])).astype(np.int64)
                yield pd.DataFrame({
                    "piece_no": np.asarray(row.numbers, np.int64)[order], "length": size[order],
                    "shard": np.full(len(size), row.shard, np.int64), "bin": assign[order],
                    "offset": ends - size[order] - first[assign[order]],
                    "done": fill[assign[order]] >= nearly_full * capacity})
    return run


def _level(items: DataFrame, shards: int, level: int, capacity: int, islands: int, epochs: int,
           nearly_full: float) -> DataFrame:
    table = items.withColumn("shard", F.pmod(F.xxhash64("piece_no", F.lit(level)), F.lit(shards))).groupBy(
        "shard").agg(F.array_sort(F.collect_list(F.struct("length", "piece_no"))).alias("items"))
    kind = "shard long, island int, sizes array<long>, numbers array<long>, score double, elites array<array<int>>"
    isles = table.select("shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"),
                         F.col("items.length").alias("sizes"), F.col("items.piece_no").alias("numbers"),
                         F.lit(None).cast("array<array<int>>").alias("elites"))
    isles = isles.repartition(_tasks(items, shards * islands))
    for epoch in range(epochs):
        if epoch:
            # each island goes on with its own best packing and its ring neighbour's
            ring = Window.partitionBy("shard").orderBy("island")
            whole_ring = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            came = F.coalesce(F.lag("elites").over(ring), F.last("elites").over(whole_ring))
            isles = isles.withColumn("came", came).withColumn(
                "elites", F.array(F.col("elites")[0], F.col("came")[0])).drop("came", "score")
        isles = isles.select("shard", "island", "sizes", "numbers", "elites").mapInPandas(_epoch(capacity, epoch), kind)
    best = isles.groupBy("shard").agg(F.max_by(
        F.struct("sizes", "numbers", F.col("elites")[0].alias("best")), F.struct("score", "island")).alias("b"))
    return best.select("shard", "b.*").mapInPandas(
        _settle(capacity, nearly_full),
        "piece_no long, length long, shard long, bin long, offset long, done boolean")


def _tasks(df: DataFrame, rows: int) -> int:
    return max(1, min(rows, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS,
         epochs: int = EPOCHS) -> DataFrame:
    """piece_no, sequence_id, offset for every piece.  Sequence ids: negative
    for whole pieces, else level, shard and bin in one number."""
    whole = pieces.filter(F.col("length") >= capacity).select(
        "piece_no", (-1 - F.col("piece_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < capacity).select("piece_no", "length")
    out, level, before = whole, 0, None
    while True:
        n = items.count()
        if n == 0:
            return out
        # lengths that fill no bin well (many equal ones) don't get better by meeting others
        last = before is not None and n > before // 2
        shards = -(-n // shard_items)
        full = 0.0 if last or shards == 1 else NEARLY_FULL
        packed = stored(_level(items, shards, level, capacity, islands, epochs, full), "pack-level")
        number = (F.lit(level).cast("long") * F.lit(1 << 56)) + F.col("shard") * F.lit(1 << 20) + F.col("bin")
        out = out.unionByName(packed.filter("done").select("piece_no", number.alias("sequence_id"), "offset"))
        items, level = packed.filter("not done").select("piece_no", "length"), level + 1
        before = n


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID,
                   capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids, sequence and offset."""
    pieces = cut_pieces(docs, tokenizer, end_id, capacity)
    return pieces.join(pack(pieces, capacity), "piece_no").drop("piece_no")


def packing_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The packing with a digest in place of the ids."""
    pieces = cut_pieces(docs, tokenizer)
    slim = pieces.select("piece_no", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return slim.join(pack(pieces), "piece_no").drop("piece_no")
