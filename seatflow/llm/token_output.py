"""Token-id output: Re-Pair grammar shards in ascending doc_id order.

Documents are range-partitioned and sorted by doc_id, tokenised whole, and
written as shards of about ``SHARD_IDS`` ids.  A shard is one binary value:
frequent pairs of adjacent ids are replaced by new symbols (nonterminals), in
rounds, until no pair makes up one ``SHARE``-th of what is left of the shard (or
occurs ``LEAST`` times, if that is more); the shard stores the rules and the number of ids
each rule expands to, so any range of ids decodes without the rest.  Shards
are rows of a Parquet table (part, shard, doc_ids, lengths, payload), so that
any store Spark writes to will do.

The start of each document is a prefix sum in three levels: per part (one row
per written partition), per shard inside a part, and inside the shard.

Defined cases: a null text is empty and yields the end id alone; rows that
repeat a doc_id are ordered by text; a null doc_id comes first; an empty table
writes an empty table.  Extra columns are ignored.  A document is never split
over shards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatflow.llm.textvec import gather, slices
from seatflow.llm.tokens import encoder, ids_crc32, tokenizer_file
from seatflow.session import scratch_path

END_ID = 0
SHARD_IDS = 1 << 20
SHARE = 4096
LEAST = 8
MAGIC = b"RPG1"
_HEAD = "<4sIIIQB"
_BINS = 20


# --- grammar ----------------------------------------------------------------

def _round(seq: np.ndarray, first_new: int, least: int, salt: int | None
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: (shorter sequence, left ids, right ids of the new rules).

    Pairs meet in hashed bins.  A bin's last pair stands for it, occurrences of
    that very pair are counted, and frequent ones become rules; a pair that
    shares its bin with another waits for the next round's hash.  Without a
    ``salt`` every pair has a bin of its own.  Of overlapping occurrences every
    other one is taken.
    """
    none = np.zeros(0, np.uint32)
    if len(seq) < 2:
        return seq, none, none
    key = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
    if salt is None:
        slot = np.unique(key, return_inverse=True)[1].astype(np.int64)
        bins = int(slot.max()) + 1
    else:
        slot, bins = ((key * np.uint64(salt)) >> np.uint64(64 - _BINS)).astype(np.int64), 1 << _BINS
    full = np.bincount(slot, minlength=bins) >= least
    pos = np.flatnonzero(full[slot])
    key, slot = key[pos], slot[pos]
    rep = np.zeros(bins, np.uint64)
    rep[slot] = key
    same = rep[slot] == key
    pos, slot = pos[same], slot[same]
    often = np.bincount(slot, minlength=bins) >= least
    keep = often[slot]
    pos, slot = pos[keep], slot[keep]
    if len(pos) == 0:
        return seq, none, none
    index = np.arange(len(pos))
    begins = np.concatenate(([True], np.diff(pos) != 1))
    take = ((index - np.maximum.accumulate(np.where(begins, index, 0))) & 1) == 0
    pos, slot = pos[take], slot[take]
    chosen = np.flatnonzero(np.bincount(slot, minlength=bins) >= 3)
    number = np.full(bins, -1, np.int64)
    number[chosen] = first_new + np.arange(len(chosen))
    symbol = number[slot]
    pos, symbol = pos[symbol >= 0], symbol[symbol >= 0]
    out = seq.copy()
    out[pos] = symbol
    stay = np.ones(len(seq), bool)
    stay[pos + 1] = False
    return out[stay], (rep[chosen] >> np.uint64(32)).astype(np.uint32), rep[chosen].astype(np.uint32)


def compress(ids: np.ndarray) -> bytes:
    """A shard's bytes."""
    seq = ids.astype(np.uint32)
    first = int(ids.max()) + 1 if len(ids) else 0
    left = right = np.zeros(0, np.uint32)
    span = np.zeros(0, np.uint32)
    salt = 0x9E3779B97F4A7C15
    while True:
        least = max(LEAST, len(seq) // SHARE)
        seq, a, b = _round(seq, first + len(left), least, salt)
        if len(a) == 0:  # perhaps only since frequent pairs shared their bins
            seq, a, b = _round(seq, first + len(left), least, None)
        if len(a) == 0:
            break
        new = _length(a, first, span) + _length(b, first, span)
        left, right, span = np.append(left, a), np.append(right, b), np.append(span, new)
        salt = (salt * 0xD6E8FEB86659FD93 + 2) & ((1 << 64) - 1) | 1
    wide = first + len(left) > 1 << 16
    seq = seq.astype("<u4" if wide else "<u2")
    return b"".join((struct.pack(_HEAD, MAGIC, first, len(left), len(seq), len(ids), 4 if wide else 2),
                     left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), span.astype("<u4").tobytes(),
                     seq.tobytes()))


def _length(symbols: np.ndarray, first: int, span: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.uint32)
    new = symbols >= first
    out[new] = span[symbols[new] - first]
    return out


def _open(payload: bytes):
    magic, first, n_rules, n_seq, n_ids, width = struct.unpack_from(_HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, out = struct.calcsize(_HEAD), []
    for n, kind in ((n_rules, "<u4"), (n_rules, "<u4"), (n_rules, "<u4"), (n_seq, f"<u{width}")):
        out.append(np.frombuffer(payload, kind, n, at).astype(np.uint32))
        at += out[-1].size * int(kind[2])
    return (first, n_ids, *out)


def _expand(seq: np.ndarray, first: int, left: np.ndarray, right: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Ids of a symbol sequence: rules are expanded once, then copied."""
    rules = np.arange(first, first + len(left), dtype=np.uint32)
    flat = rules
    while len(flat) and (flat >= first).any():
        new = flat >= first
        ends = np.cumsum(1 + new)
        wider = np.repeat(flat, 1 + new)
        wider[ends[new] - 2] = left[flat[new] - first]
        wider[ends[new] - 1] = right[flat[new] - first]
        flat = wider
    pool = np.concatenate((np.arange(first, dtype=np.uint32), flat))
    at = np.concatenate((np.arange(first), first + np.cumsum(span, dtype=np.int64) - span))
    length = np.concatenate((np.ones(first, np.int64), span.astype(np.int64)))
    return gather(pool, at[seq], length[seq])


def decompress(payload: bytes) -> np.ndarray:
    first, _, left, right, span, seq = _open(payload)
    return _expand(seq, first, left, right, span)


def decode_range(payload: bytes, start: int, length: int) -> np.ndarray:
    """Ids [start, start + length) of a shard; only the symbols that cover
    them are expanded."""
    first, n_ids, left, right, span, seq = _open(payload)
    start, stop = max(0, start), min(start + length, n_ids)
    if stop <= start:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(_length(seq, first, span), dtype=np.int64)
    i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
    before = int(ends[i - 1]) if i else 0
    return _expand(seq[i:j + 1], first, left, right, span)[start - before:stop - before]


# --- Spark ------------------------------------------------------------------

SHARD_SCHEMA = "part int, shard int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()),
                          ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                          ("payload", pa.binary())])


def _write_part(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        docs: list = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pylist([{
                "part": part, "shard": shard, "n_ids": len(flat), "doc_ids": docs,
                "lengths": np.concatenate(lengths).tolist(), "payload": compress(flat)}], _SHARD_ARROW)

        held = 0
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for i, j, buf, off in slices(texts):
                flat, at = enc(buf, off)
                n = j - i
                out = np.insert(flat, at[1:], end_id)  # after each document
                docs += names[i:j].to_pylist()
                ids.append(out)
                lengths.append(np.diff(at) + 1)
                held += len(flat) + n
                if held >= shard_ids:
                    yield flush()
                    shard, held, docs, ids, lengths = shard + 1, 0, [], [], []
        if held:
            yield flush()
    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 shard_ids: int = SHARD_IDS) -> None:
    """Write every document's ids, in ascending doc_id order, to ``path``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write_part(tokenizer or tokenizer_file(), end_id, shard_ids), SHARD_SCHEMA).write.mode(
        "overwrite").parquet(path)


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids = decompress(batch.column("payload")[row].as_py())
            length = np.asarray(batch.column("lengths")[row].as_py(), np.int64)
            ends = np.cumsum(length)
            crc = [ids_crc32(ids[b - n:b]) for n, b in zip(length.tolist(), ends.tolist())]
            n = len(length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column("part")[row].as_py(), np.int32)),
                 pa.array(np.full(n, batch.column("shard")[row].as_py(), np.int32)),
                 batch.column("doc_ids")[row].values, pa.array(ends - length), pa.array(length),
                 pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the shards alone."""
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per written partition
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard")
    first = sizes.withColumn("base_in", F.sum("n_ids").over(inside) - F.col("n_ids")).join(parts, "part").select(
        "part", "shard", (F.col("base") + F.col("base_in")).alias("base"))
    rows = shards.select("part", "shard", "doc_ids", "lengths", "payload").mapInArrow(
        _read_docs, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(first, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
