"""Streaming operators.

Stateful rules use ``transformWithState`` (in frames, one or a few per shard and
micro-batch) keyed by the shard of the rule's key
(event, booking or client), so state is spread over the cluster by key and
survives restarts in the checkpoint.  Their rows wait in state until the
watermark passes them and are then taken in event-time order (``ordered.py``),
so the results equal the batch twins (W1, W2, W7, P6) however the rows are
dealt over micro-batches, as long as they come within the watermark's delay.
Timestamps without a zone are cast to timestamps first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatflow.operators.changes import apply_status
from seatflow.operators.replay import INVENTORY_OUT, NOT_ENOUGH, RATE_OUT, UNKNOWN_EVENT
from seatflow.operators.validate import validate_messages
from seatflow.schemas import CONFIRMED, KEY_REMAINING_PREFIX, PENDING_TTL_MINUTES
from seatflow.sources.documents import gauge_samples, stats_documents
from seatflow.sources.messages import parse_booking_messages
from seatflow.streaming.ordered import (FIRST_TIME, LAST_TIME, NO_TIME, SHARDS, WIDTH_MS, AdmitProcessor, Frames, InOrder,
                                        InventoryProcessor, RateLimitProcessor, SettleProcessor)
from seatflow.streaming.runner import path_exists

WATERMARK_DELAY = "15 minutes"
GAUGE_INTERVAL = "15 seconds"
KEY_BUCKETS = 16


def event_time(df: DataFrame, col: str = "ts", delay: str = WATERMARK_DELAY) -> DataFrame:
    """``col`` as a zoned timestamp ``event_ts`` with a watermark of ``delay``."""
    return df.withColumn("event_ts", F.col(col).cast("timestamp")).withWatermark("event_ts", delay)


# -------------------------------------------------------------- T3 / T7
ADMIT_OUT = T.StructType([T.StructField("id", T.StringType()), T.StructField("event_id", T.StringType()),
                          T.StructField("quantity", T.IntegerType()), T.StructField("created_at", T.TimestampNTZType()),
                          T.StructField("admitted", T.BooleanType()), T.StructField("remaining", T.IntegerType())])


def _shard(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SHARDS)).cast("int").alias("shard")


_SEATS = (("event_id", "string"), ("remaining", "int"), ("capacity", "int"))
_BOOKINGS = (("booking_id", "string"), ("event_id", "string"), ("quantity", "int"), ("unit_price_cents", "bigint"),
             ("status", "string"))


def _seats(events: DataFrame) -> DataFrame:
    left = "remaining" if "remaining" in events.columns else "capacity"
    return events.select(F.col("id").alias("event_id"), F.col(left).alias("remaining"), "capacity")


def _timed(rows: DataFrame, ts: str, fields, key: str, delay: str, shard: Column | None = None):
    """``rows`` by shard, in the columns of ``ordered.InOrder``, with a watermark on ``event_ts``."""
    timed = rows.withColumn("ts_us", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NO_TIME))).select(
        *[F.col(c).cast(kind).alias(c) for c, kind in fields], F.col(key).cast("string").alias("key"),
        _shard(F.col(key)) if shard is None else shard, _in_frames(F.col(ts).cast("timestamp")).alias("event_ts"))
    return event_time(timed, "event_ts", delay).groupBy("shard")


def _in_frames(ts: Column) -> Column:
    """A time that nanoseconds can say: the first and the last there are for those beyond."""
    first, last = (F.lit(t).cast("timestamp") for t in (FIRST_TIME, LAST_TIME))
    return F.when(ts < first, first).when(ts > last, last).otherwise(ts)


def _in_order(rows, rule: InOrder, out: T.StructType, table: DataFrame | None = None, start: str = "",
              seeds: tuple = ()) -> DataFrame:
    """What ``rule`` gives for ``rows`` of ``_timed``; ``table`` holds the values it starts from, in the
    columns ``seeds``, the first of them the key."""
    if table is not None:
        table = table.select(_shard(F.col(seeds[0][0])), *[F.col(c).cast(kind).alias(c) for c, kind in seeds]).groupBy("shard")
    return rows.transformWithStateInPandas(statefulProcessor=Frames(rule, start, seeds), outputStructType=out,
                                           outputMode="Append", timeMode="EventTime", initialState=table)


def _span_ms(delay: str) -> int:
    """Width of a stored bucket: rows wait for about eight of them."""
    return _micros(delay) // 8000


def _micros(interval: str | None) -> int | None:
    return None if interval is None else int(pd.Timedelta(interval) / pd.Timedelta(microseconds=1))


def inventory_stream(commands: DataFrame, events: DataFrame, delay: str = WATERMARK_DELAY, ttl: str | None = None,
                     keep: str | None = None, width_ms: int = WIDTH_MS) -> DataFrame:
    """T3 + T7: admission and release on a command stream keyed by event, in
    event-time order whatever order the rows come in, ``delay`` at most apart.
    ``events`` (id, capacity[, remaining]) seed the state once.  Output: one
    row per command as W2 (``applied``, ``remaining`` after it).

    ``ttl`` cancels bookings not settled in time (T2) in the same query: the
    cancels come out as rows of their own (seq 0, at the deadline).  ``keep``
    frees a booking's state that long after its last effective command."""
    rule = InventoryProcessor(width_ms, _span_ms(delay), _micros(ttl), _micros(keep))
    return _in_order(_timed(commands, "ts", rule.fields, "event_id", delay), rule, INVENTORY_OUT, _seats(events), "seats",
                     _SEATS)


def admit_stream(requests: DataFrame, events: DataFrame, delay: str = WATERMARK_DELAY,
                 width_ms: int = WIDTH_MS) -> DataFrame:
    """Requests (id, event_id, quantity, created_at) admitted in the order
    of their times, whatever order they come in, ``delay`` at most apart; same
    columns and reasons as W1.  A request without a time is decided when it
    arrives.  State is one value per event and the requests still waiting."""
    rule = AdmitProcessor(width_ms, _span_ms(delay))
    out = _in_order(_timed(requests, "created_at", rule.fields, "event_id", delay), rule, ADMIT_OUT, _seats(events), "seats",
                    _SEATS[:2])
    return out.withColumn("reason", F.when(F.col("remaining").isNull(), F.lit(UNKNOWN_EVENT)).when(
        ~F.col("admitted"), F.lit(NOT_ENOUGH)))


# -------------------------------------------------------------------- T4
def rate_limit_stream(log: DataFrame, key: str, token_us: int, burst: int, delay: str = WATERMARK_DELAY,
                      width_ms: int = WIDTH_MS) -> DataFrame:
    """T4: W7 live.  ``log`` must be streaming with ``ts``; output as W7.  Rows
    may come in any order, ``delay`` at most apart; those further behind are
    dropped by Spark and counted (``runner.ProgressLog``)."""
    rows = log.select(F.col(key).alias("key"), "request_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    rule = RateLimitProcessor(token_us, burst, width_ms, _span_ms(delay))
    return _in_order(_timed(rows, "ts", rule.fields, "key", delay), rule, RATE_OUT)


# -------------------------------------------------------------------- T2
def expire_pending_stream(commands: DataFrame, ttl_minutes: int = PENDING_TTL_MINUTES,
                          delay: str = WATERMARK_DELAY) -> DataFrame:
    """Bookings not confirmed or cancelled within ``ttl_minutes`` of their
    CREATE, reported once the watermark passes the deadline.

    A stream-stream left outer join of CREATEs with settles of the same
    booking inside [created_at, created_at + ttl]: the time range lets Spark
    drop join state behind the watermark, and a CREATE still unmatched when
    the watermark passes its deadline comes out with a NULL settle, which is
    the expiry.  A settle at exactly the deadline counts as in time.  All
    JVM-side; no Python per row.
    """
    # a literal interval, so the planner can bound join state by the watermark
    ttl = F.expr(f"INTERVAL {int(ttl_minutes)} MINUTES")
    cm = F.col("command")
    created = (commands.where(cm == "CREATE")
               .select("booking_id", F.col("ts").cast("timestamp").alias("created_ts"), F.col("ts").alias("created_at"))
               .withWatermark("created_ts", delay))
    settles = (commands.where(cm.isin("CONFIRM", "CANCEL"))
               .select(F.col("booking_id").alias("settled_id"), F.col("ts").cast("timestamp").alias("settled_ts"))
               .withWatermark("settled_ts", delay))
    cond = ((F.col("booking_id") == F.col("settled_id")) & (F.col("settled_ts") >= F.col("created_ts"))
            & (F.col("settled_ts") <= F.col("created_ts") + ttl))
    j = created.join(settles, cond, "left_outer")
    return j.where(F.col("settled_id").isNull()).select("booking_id", (F.col("created_at") + ttl).alias("expires_at"))


def expired_bookings(commands: DataFrame, ttl_minutes: int = PENDING_TTL_MINUTES) -> DataFrame:
    """T2's batch twin: CREATEs with no CONFIRM or CANCEL from created_at to
    created_at + ttl (an anti join on the booking with a time residual)."""
    ttl = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(ttl_minutes), F.lit(0))
    created = commands.where(F.col("command") == "CREATE").select(
        "booking_id", (F.col("ts") + ttl).alias("expires_at"), F.col("ts").alias("_c"))
    settles = commands.where(F.col("command").isin("CONFIRM", "CANCEL")).select(
        F.col("booking_id").alias("_b"), F.col("ts").alias("_t"))
    cond = ((F.col("booking_id") == F.col("_b")) & (F.col("_t") >= F.col("_c"))
            & (F.col("_t") <= F.col("expires_at")))
    return created.join(settles, cond, "left_anti").drop("_c")


def expiry_cancels(expired: DataFrame, commands: DataFrame) -> DataFrame:
    """T2's expiries as the CANCEL commands that carry them out, with the
    columns of ``commands``: at the deadline, for the CREATE's event and
    quantity.  C2 applies them, and C3 and T7 give the seats back.  No other
    command of the booking is at the deadline, so ``seq`` is free there."""
    created = commands.where(F.col("command") == "CREATE").dropDuplicates(["booking_id"])
    due = expired.select(F.col("booking_id").alias("_b"), F.col("expires_at"))
    out = created.join(due, F.col("booking_id") == F.col("_b"))
    new = {"command": F.lit("CANCEL"), "ts": F.col("expires_at"), "seq": F.lit(0).cast(commands.schema["seq"].dataType)}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in commands.columns])


# -------------------------------------------------------------------- T6
def dedupe_messages(parsed: DataFrame, key: str = "booking_id", delay: str | None = None) -> DataFrame:
    """Drop redelivered messages.  The keys seen so far are the state (one
    row per key, in RocksDB), so a first copy passes however late it comes.
    With a ``delay`` a key is forgotten once the watermark has passed it; that
    bounds the state, and rows behind the watermark are then dropped (see
    ``runner.ProgressLog``)."""
    if delay is None:
        return parsed.dropDuplicates([key])
    return event_time(parsed, "ts", delay).dropDuplicatesWithinWatermark([key]).drop("event_ts")


class SeenKeys:
    """T6 with bounded state that loses no first copy: the second level.

    Keys of the last while are state, dropped by age of arrival.  A row whose
    key is not among them may still repeat an older one, so each micro-batch's
    survivors are checked against a stored table of all keys, bucketed by their
    hash (Spark prunes the buckets that a batch does not hit), and then join
    it.  A retried batch overwrites its own part of the table and of the
    result and only looks at earlier batches.
    """

    def __init__(self, spark, path: str, key: str = "booking_id", buckets: int = KEY_BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _table(self, name: str, like: DataFrame) -> DataFrame | None:
        where = f"{self.path}/{name}"
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema)
        return self.spark.read.schema(kinds).parquet(where) if path_exists(self.spark, where) else None

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(
            f"{self.path}/{name}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).withColumn(
            "batch_id", F.lit(batch_id))
        keys = rows.select(self.key, "bucket", "batch_id")
        seen = self._table("keys", keys)
        if seen is not None:
            same = [rows["bucket"] == seen["bucket"], rows[self.key].eqNullSafe(seen[self.key])]
            rows = rows.join(seen.where(F.col("batch_id") < batch_id), same, "left_anti")
        self._write(rows.drop("bucket"), "rows", "batch_id")
        kept = self.spark.read.schema(rows.drop("bucket").schema).parquet(f"{self.path}/rows").where(
            F.col("batch_id") == batch_id)
        self._write(kept.select(self.key, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"),
                                "batch_id"), "keys", "bucket", "batch_id")

    def result(self) -> DataFrame:
        """The first copies so far."""
        return self.spark.read.parquet(f"{self.path}/rows").drop("batch_id")


def dedupe_stream(parsed: DataFrame, sink: SeenKeys, recent: str = "1 day"):
    """T6 in two levels: a key's copies that arrive within ``recent`` of each
    other are dropped by Spark's state, which forgets them after that; all
    others by ``sink``.  The age is that of arrival, not of the message, so no
    row is ever too late.  Returns the writer."""
    cols = parsed.columns
    arrived = parsed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", recent)
    return arrived.dropDuplicatesWithinWatermark([sink.key]).select(*cols).writeStream.foreachBatch(sink)


# -------------------------------------------------------------------- T1
LOG_SCHEMA = "booking_id string, ts timestamp_ntz, seq int, reason string, batch_id int"


class SettleSink:
    """T1's ``foreachBatch``: every valid message confirms its booking.

    A micro-batch is one pass over its own messages: each goes to a log, with
    the reason if it is refused, and never meets the bookings.  The log is
    partitioned by batch id, so a retried batch overwrites its own part.  The
    bookings are read when somebody asks for the table: ``current`` folds the
    first confirmation per booking into the snapshot (C2).
    """

    def __init__(self, base: DataFrame, log_path: str):
        self.base, self.log_path = base, log_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        refused = F.when(F.size("errors") > 0, F.concat_ws(",", "errors"))
        (validate_messages(batch)
         .select("booking_id", "ts", F.col("copy").cast("int").alias("seq"), refused.alias("reason"),
                 F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(self.log_path))

    def log(self) -> DataFrame:
        spark = self.base.sparkSession
        if not path_exists(spark, self.log_path):
            return spark.createDataFrame([], LOG_SCHEMA)
        return spark.read.schema(LOG_SCHEMA).parquet(self.log_path)

    def current(self) -> DataFrame:
        """The table after all batches so far.  The first confirmation in
        (batch, ts, seq) order counts; later ones change nothing."""
        first = self.log().where(F.col("reason").isNull()).groupBy("booking_id").agg(
            F.min(F.struct("batch_id", "ts", "seq")).alias("_f"))
        return apply_status(self.base, first.select("booking_id", "_f.ts", "_f.seq",
                                                    F.lit("CONFIRM").alias("command")))

    def rejects(self) -> DataFrame:
        """Refused messages and those that name no known booking."""
        log = self.log()
        unknown = log.where(F.col("reason").isNull()).join(
            self.base.select(F.col("id").alias("booking_id")), "booking_id", "left_anti")
        return log.where(F.col("reason").isNotNull()).select("booking_id", "reason").unionByName(
            unknown.select("booking_id", F.lit("UNKNOWN_BOOKING").alias("reason")))

    def compact(self, base_path: str, log_path: str) -> "SettleSink":
        """Write the current table as a new base snapshot and return a sink
        that continues from it with an empty log (the caller swaps sinks
        between batches).  Replaying a batch already in the snapshot is
        harmless: a confirmation of a confirmed booking changes nothing."""
        self.current().write.mode("errorifexists").parquet(base_path)
        return SettleSink(self.base.sparkSession.read.parquet(base_path), log_path)


def settle_stream(messages: DataFrame, sink: SettleSink):
    """Parse (S3) -> check (P11) -> log of confirmations and refusals per
    micro-batch.  Returns the writer; the caller sets checkpoint and
    trigger."""
    return parse_booking_messages(messages).writeStream.foreachBatch(sink)


SETTLED = T.StructType([
    T.StructField("booking_id", T.StringType()), T.StructField("event_id", T.StringType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("unit_price_cents", T.LongType()),
    T.StructField("from_status", T.StringType()), T.StructField("to_status", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("reason", T.StringType())])


def settle_or_cancel(messages: DataFrame, bookings: DataFrame, fails: Column | None = None,
                     delay: str = WATERMARK_DELAY, width_ms: int = WIDTH_MS) -> DataFrame:
    """T1 in full: each message confirms its booking, or cancels it if the
    confirmation ``fails`` (a condition on the parsed message).

    The status of every booking is keyed state, seeded by ``bookings`` (id,
    event_id, quantity, unit_price_cents, status) when the query first starts
    and never read again.  Output: the real status changes in event-time order,
    and one row with a ``reason`` per refused message (P11's errors, or
    UNKNOWN_BOOKING).  A repeated outcome changes nothing and gives no row;
    a confirmation after a cancel passes, as coded.  C3 gives the seats of
    changes into CANCELLED back, T5 and ``stats_stream`` follow the rest."""
    parsed = validate_messages(parse_booking_messages(messages))
    bad = F.size("errors") > 0
    rows = parsed.select(
        F.when(~bad, F.col("booking_id")).alias("key"), F.when(bad, F.col("body")).alias("spread"), "ts", "booking_id",
        F.col("copy").cast("int").alias("seq"), F.when(bad, F.concat_ws(",", "errors")).alias("reason"),
        F.coalesce(F.lit(False) if fails is None else fails, F.lit(False)).alias("fails"))
    held = bookings.select(F.col("id").alias("booking_id"), "event_id", "quantity", "unit_price_cents", "status")
    # a refused message names no booking to go with; it goes by its text
    shard = _shard(F.coalesce("key", "spread"))
    rule = SettleProcessor(width_ms, _span_ms(delay))
    return _in_order(_timed(rows, "ts", rule.fields, "key", delay, shard), rule, SETTLED, held, "bookings", _BOOKINGS)


def stats_stream(changes: DataFrame, sink_path: str):
    """S6 kept up by status changes (``settle_or_cancel``'s output as a
    stream): in update mode only the documents of events that changed are
    written, in the batch's own part.  Returns the writer."""
    became, was = (F.col(c).eqNullSafe(F.lit(CONFIRMED)) for c in ("to_status", "from_status"))
    seats = F.col("quantity").cast("bigint") * F.when(became, 1).when(was, -1).otherwise(0)
    totals = changes.where(F.col("reason").isNull()).groupBy("event_id").agg(
        F.sum(seats).cast("bigint").alias("tickets_sold"),
        F.sum(seats * F.col("unit_price_cents")).cast("bigint").alias("revenue_cents"))

    def write(batch: DataFrame, batch_id: int) -> None:
        (stats_documents(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink_path))

    return totals.writeStream.outputMode("update").foreachBatch(write)


def latest_documents(docs: DataFrame) -> DataFrame:
    """The last document written per key."""
    return docs.groupBy("key", "event_id").agg(F.max_by("value", "batch_id").alias("value"))


def live_counters(spark, checkpoint: str) -> DataFrame:
    """The key-value counters ``event:remaining:<id>`` as a running (or ended)
    T3 / T7 query holds them in its state, read by Spark's state source; the
    input of A7 and J6."""
    state = spark.read.format("statestore").option("stateVarName", "seats").load(checkpoint)
    seats = state.select(F.explode(F.arrays_zip("value.event_id", "value.remaining")).alias("s"))
    return seats.select(F.concat(F.lit(KEY_REMAINING_PREFIX), F.col("s.event_id")).alias("key"),
                        F.col("s.remaining").alias("remaining"))


# -------------------------------------------------------------------- T5
def gauge_stream(changes: DataFrame, sink_path: str, every: str = GAUGE_INTERVAL):
    """T5: running CONFIRMED totals per event (update mode: only events that
    changed are emitted) written as gauge samples by ``foreachBatch``.

    ``changes`` are status changes (event_id, quantity, unit_price_cents,
    from_status, to_status, ts): entering CONFIRMED adds, leaving it takes
    away, anything else changes no total.  A sample's time is the event's
    latest change, so a replayed batch writes the same samples.  Samples are
    taken ``every`` so often, the service's refresh interval (the caller may set
    another trigger)."""
    became, was = (F.col(c).eqNullSafe(F.lit(CONFIRMED)) for c in ("to_status", "from_status"))
    seats = F.col("quantity").cast("bigint") * F.when(became, 1).otherwise(-1)
    totals = (changes.where(became != was).groupBy("event_id")
              .agg(F.sum(seats).cast("bigint").alias("tickets_sold"),
                   F.sum(seats * F.col("unit_price_cents")).cast("bigint").alias("revenue_cents"),
                   F.max("ts").alias("ts")))

    def write(batch: DataFrame, batch_id: int) -> None:
        stats = batch.withColumn("revenue", F.col("revenue_cents").cast("double") / 100.0)
        (gauge_samples(stats, F.col("ts")).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    return totals.writeStream.outputMode("update").trigger(processingTime=every).foreachBatch(write)


def latest_gauges(samples: DataFrame) -> DataFrame:
    """Latest value per (metric, event_id) of the gauge samples."""
    return samples.groupBy("metric", "event_id").agg(F.max_by("value", "batch_id").alias("value"))


def fold_gauges(samples: DataFrame, path: str, upto: int) -> DataFrame:
    """The samples of batches up to ``upto`` folded into one per (metric,
    event), written to ``path``, with the later samples as they are: what
    ``latest_gauges`` has to read stays one row per gauge and the samples since."""
    old = samples.where(F.col("batch_id") <= upto).groupBy("metric", "event_id").agg(
        F.max_by(F.struct("value", "ts", "batch_id"), "batch_id").alias("s"))
    old.select("metric", "event_id", "s.*").write.mode("errorifexists").parquet(path)
    cols = ["metric", "event_id", "value", "ts", "batch_id"]
    return samples.sparkSession.read.parquet(path).select(*cols).unionByName(
        samples.where(F.col("batch_id") > upto).select(*cols))


# -------------------------------------------------------------------- T8
def log_arrivals(stream: DataFrame, path: str, ts: str = "ts", delay: str = WATERMARK_DELAY):
    """Every row of a stream as it arrives, with its batch, in one write
    per micro-batch (a retried batch overwrites its own part).  ``delay`` sets
    the stream's watermark.  Returns the writer."""
    cols = stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(*cols).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return event_time(stream, ts, delay).writeStream.foreachBatch(write)


def split_late(arrivals: DataFrame, watermarks: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(late, on time) rows of ``log_arrivals``.  ``watermarks`` are what
    Spark reported (``runner.ProgressLog``): batch_id and the watermark the
    batch ran under.  As in Spark's stateful steps, a row at or behind it is
    late; a row without a time, or of a batch without a watermark, is not."""
    marked = arrivals.join(watermarks, "batch_id", "left")
    late = F.coalesce(F.col(ts).cast("timestamp") <= F.col("watermark"), F.lit(False))
    return tuple(marked.where(c).select(*arrivals.columns) for c in (late, ~late))
