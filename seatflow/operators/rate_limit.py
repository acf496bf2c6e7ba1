"""W7 over stored ranges: a client with half of the log is not one task.

The token bucket in the form of a due time: a bucket that holds ``tok`` at
time ``t`` is ``x = t + full - tok``.  A request is allowed if
``x <= t + full - token``, and then ``x = max(x, t) + token``; a refused one
leaves ``x``.  All that a request needs of those before it is ``x``, and a
bucket that is full again (``x <= t``) has forgotten them: an idle gap cuts a
client's log into sessions.

The log is range-partitioned once by (client, time), so a client is a chunk in
each of the ranges it covers.  Every chunk is folded at once from a guess of
the ``x`` at its start (at first: full).  The ends of chunks are then chained
per client, one small row per range, and a chunk whose guess differs from what
its predecessor gives is folded again.  A chunk with a cut in it ends the same
whatever came before, so most chains close at once.  A client above its limit
throughout has no cut; there ``x`` moves in whole tokens, so the next guess
carries its remainder through all chunks of the chain, which the next round
confirms.  Each round settles one more chunk of every client at least, so the
result is exact at any input; only a client that hovers about its limit without
ever idling or being refused near a chunk's end takes a round per chunk.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatflow.session import ranged, reliable_checkpoint

RATE_OUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("request_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("allowed", T.BooleanType()),
    T.StructField("tokens", T.LongType()),
])
FULL = -(1 << 62)  # the x of a full bucket: before any time
# the end of a chunk: x before and after, whether it was full in between, whether it ends refused
CHUNK = "_range int, _first long, _last long, _in long, _out long, _cut boolean, _refused boolean"
FOLDED = f"key string, request_id string, ts timestamp_ntz, allowed boolean, tokens long, {CHUNK}"


def take(us: list[int], x: int, token: int, full: int, first: bool) -> tuple[list[bool], list[int], bool]:
    """One client's requests in order: whether each is allowed, x after each,
    and whether the bucket was full at one (but the ``first``)."""
    allowed: list[bool] = []
    after: list[int] = []
    cut, i, n, wait = False, 0, len(us), full - token
    while i < n:
        t = us[i]
        if x <= t:
            cut, x = cut or not (first and i == 0), t
        if x - t <= wait:
            x += token
            allowed.append(True)
            after.append(x)
            i += 1
        else:  # refused up to the request that finds a token again
            j = bisect_left(us, x - wait, i + 1, n)
            allowed.extend([False] * (j - i))
            after.extend([x] * (j - i))
            i = j
    return allowed, after, cut


def _fold(token: int, full: int):
    """The chunks of one range, in order; a row that ``_begins`` starts its
    chunk from ``_x``.  The first and the last chunk also report their end, since
    only they can go on in another range."""
    names = [p.split()[0] for p in FOLDED.split(", ")]
    whole = ("tokens", "_range", "_first", "_last", "_in", "_out")
    kinds = {c: "Int64" if c in whole else "datetime64[us]" if c == "ts" else object for c in names}

    def frame(columns: dict) -> pd.DataFrame:
        return pd.DataFrame(columns).reindex(columns=names).astype(kinds)

    def end(c: dict) -> pd.DataFrame:
        return frame({k: pd.Series([v], dtype=object) for k, v in c.items()})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, n = None, 0
        for b in batches:
            key = b["key"].astype(object).where(b["key"].notna(), None).to_numpy()
            start, begins, us = b["_x"].to_numpy(), b["_begins"].to_numpy(), b["_us"].to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(b)] if len(b) else []
            allowed, after = [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if chunk is None or chunk["key"] != key[lo]:
                    if n == 1:
                        yield end(chunk)
                    n += 1
                    chunk = {"key": key[lo], "_range": int(b["_range"].iloc[lo]), "_first": None, "_last": None,
                             "_in": FULL, "_out": FULL, "_cut": False, "_refused": False}
                if begins[lo]:
                    chunk["_in"] = chunk["_out"] = int(start[lo])
                    lo += 1
                if lo == hi:
                    continue
                ok, xs, cut = take(us[lo:hi].tolist(), chunk["_out"], token, full, chunk["_first"] is None)
                if chunk["_first"] is None:
                    chunk["_first"] = int(us[lo])
                chunk.update(_last=int(us[hi - 1]), _out=xs[-1], _cut=chunk["_cut"] or cut, _refused=not ok[-1])
                allowed += ok
                after += xs
            rows = b[~begins]
            yield frame({"key": key[~begins], "request_id": rows["request_id"].to_numpy(), "ts": rows["ts"].to_numpy(),
                         "allowed": np.array(allowed, object), "_range": rows["_range"].to_numpy(),
                         "tokens": full - np.maximum(np.array(after, np.int64) - us[~begins], 0)})
        if chunk is not None:
            yield end(chunk)

    return fold


def _chain(token: int, full: int):
    """Chunk ends of one client after the other, in order of range: the x that
    each chunk should have started from, where that is not the one it did."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, x = object(), FULL
        for b in batches:
            out = []
            for c in b.itertuples(index=False):
                key = None if pd.isna(c.key) else c.key
                if key != now:
                    now, x = key, FULL
                start = FULL if x <= c.first else x
                if start == c.started:
                    x = c.out
                    continue
                out.append((key, c.range, start))
                if c.cut or start == FULL:
                    x = c.out
                elif c.refused:  # the least whole number of tokens from start that is refused
                    late = c.last + full - token
                    x = start + max(0, (late - start) // token + 1) * token
                else:
                    x = min(start + c.out - max(c.started, c.first), c.last + full)
            yield pd.DataFrame(out, columns=["key", "_range", "_x"])

    return chain


def replay_rate_limit(log: DataFrame, key: str, token_us: int, burst: int,
                      order: tuple[str, ...] = ("ts", "request_id"), partitions: int | None = None) -> DataFrame:
    """Token bucket per ``key`` over the access log.

    The bucket starts full (``burst`` tokens), earns one token every
    ``token_us`` microseconds up to ``burst``, and each request takes one
    token; a refused request takes none.  Tokens are counted in whole
    token-microseconds, so the result is exact.  ``tokens`` is what is left
    after the request.  Plans: 2/s burst 5 per client IP is
    ``token_us=500_000, burst=5``; 10/s burst 20 per user is
    ``token_us=100_000, burst=20``.  A request without a time is refused and
    has no ``tokens``; requests without a key share one bucket.
    """
    full = token_us * burst
    rows = log.select(F.col(key).cast("string").alias("key"), F.col("request_id").cast("string").alias("request_id"),
                      F.col("ts").cast("timestamp_ntz").alias("ts"),
                      F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    timed = ranged(rows.where(F.col("ts").isNotNull()), ["key", *order], "rate-input", partitions=partitions)
    n = partitions or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def folded(part: DataFrame, starts: DataFrame | None, name: str) -> DataFrame:
        part = part.withColumns({"_x": F.lit(0).cast("long"), "_begins": F.lit(False)})
        if starts is not None:
            part = part.unionByName(starts.withColumns({"_us": F.lit(0).cast("long"), "_begins": F.lit(True)}),
                                    allowMissingColumns=True)
        part = part.repartitionById(n, "_range").sortWithinPartitions("_range", "key", F.desc("_begins"), *order)
        return reliable_checkpoint(part.mapInPandas(_fold(token_us, full), FOLDED), name)

    ends = ["key", "_range", "_first", "_last", "_in", "_out", "_cut", "_refused"]
    done = folded(timed, None, "rate-fold")
    chunks = done.where(F.col("_out").isNotNull()).select(*ends)
    done, rounds = done.where(F.col("_out").isNull()), 0
    while True:
        rounds += 1
        told = chunks.select("key", *[F.col(c).alias(a) for c, a in zip(
            ends[1:], ("range", "first", "last", "started", "out", "cut", "refused"))])
        starts = reliable_checkpoint(told.repartition("key").sortWithinPartitions("key", "range").mapInPandas(
            _chain(token_us, full), "key string, _range int, _x long"), "rate-starts")
        if starts.isEmpty():
            break
        same = F.col("key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))
        again = starts.select(F.col("key").alias("_k"), F.col("_range").alias("_r"))  # a row per range at most
        new = folded(timed.join(again, same, "left_semi"), starts, f"rate-fold{rounds}")
        fresh = new.where(F.col("_out").isNotNull()).select(*ends)
        chunks = reliable_checkpoint(chunks.join(again, same, "left_anti").unionByName(fresh), "rate-chunks")
        done = done.join(again, same, "left_anti").unionByName(new.where(F.col("_out").isNull()))
    untimed = rows.where(F.col("ts").isNull()).select("key", "request_id", "ts", F.lit(False).alias("allowed"),
                                                      F.lit(None).cast("long").alias("tokens"))
    return done.select(*RATE_OUT.names).unionByName(untimed)
