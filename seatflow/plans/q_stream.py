"""Registered streaming queries.

Each stages its fixture view into a landing folder in event-time slices and
runs the real streaming query once per slice (``availableNow``), then reads
the sink back.  The oracle is the batch twin's SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seatflow.operators.changes import apply_status, release_cancelled
from seatflow.operators.joins import inventory_drift
from seatflow.plans.catalog import fx, register
from seatflow.plans.q_replay import BURST, TOKEN_US, W1_STEPS, W2_STEPS, W7_STEPS
from seatflow.session import reliable_checkpoint
from seatflow.sources.messages import parse_booking_messages
from seatflow.streaming import operators as S
from seatflow.streaming.runner import SliceReplay, enable_state_store, slice_numbers

SLICES = 4
ORDER_DAYS = 120  # how far booking requests and commands are out of order (the fixtures span years)
_PARSED_SQL = """SELECT *, json_valid(body) AS parsed,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.booking_id') END AS booking_id,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.user_id') END AS user_id,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.event_id') END AS event_id,
  CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.quantity') AS INTEGER) END AS quantity
FROM v_booking_messages"""


def _stored(df):
    """The view computed once: its time bounds, slices and heartbeats read the stored rows."""
    return reliable_checkpoint(df, "view")


def _sliced(df, ts_col="ts", slices=SLICES):
    return df.withColumn("_slice", slice_numbers(df, ts_col, slices)), list(range(slices))


def _append_to(sink):
    return lambda out: out.writeStream.format("parquet").option("path", sink).outputMode("append")


def _heartbeats(like, ts_col, rows, beats=(1,)):
    """Frames ``beats`` days past the end of ``like`` that move every
    watermark beyond the last deadline (the no-data batch Spark runs after
    the watermark moves then flushes the state); ``rows`` are column ->
    value dicts of one frame (the timestamp is added)."""
    hi = like.agg(F.max(ts_col)).first()[0]
    day = F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    out = []
    for n in beats:
        frame = None
        for vals in rows:
            r = like.limit(1).select(*[F.lit(v(n) if callable(v) else v).cast(like.schema[c].dataType).alias(c)
                                       for c, v in vals.items()],
                                     (F.lit(str(hi)).cast(like.schema[ts_col].dataType) + day * n).alias(ts_col))
            frame = r if frame is None else frame.unionByName(r)
        out.append(frame)
    return out


def _shuffled(df, ts_col, key, days, slices=SLICES):
    """Rows that arrive up to ``days`` after their time, by a hash of ``key``:
    dealt over slices by arrival, so a slice holds rows from before and after
    its neighbours' rows."""
    late = F.make_dt_interval(F.pmod(F.xxhash64(key), F.lit(days)).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    dealt = df.withColumn("_arrival", F.col(ts_col) + late)
    return dealt.withColumn("_slice", slice_numbers(dealt, "_arrival", slices)).drop("_arrival"), list(range(slices))


# -------------------------------------------------------------------- T1
def _settled(spark, sf):
    f = fx(spark, sf)
    base = f.bookings.withColumn("status", F.lit("PENDING")).withColumn("updated_at", F.col("created_at"))
    run = SliceReplay(spark, "t1-settle")
    sink = S.SettleSink(base, run.sink)
    src, slices = _sliced(f.booking_messages)
    run.run(src, "_slice", slices, lambda s: S.settle_stream(s, sink))
    return sink


@register("T1_settle_stream", """SELECT b.id, CASE WHEN m.t IS NULL THEN 'PENDING' ELSE 'CONFIRMED' END AS status,
  COALESCE(m.t, b.created_at) AS updated_at
FROM v_bookings b LEFT JOIN (SELECT booking_id, MIN(ts) AS t FROM pm WHERE parsed
  AND COALESCE(booking_id, '') <> '' AND COALESCE(user_id, '') <> '' AND COALESCE(event_id, '') <> ''
  AND quantity > 0 GROUP BY booking_id) m ON m.booking_id = b.id""", {"pm": _PARSED_SQL})
def t1(spark, sf):
    return _settled(spark, sf).current().select("id", "status", "updated_at")


@register("T1_settle_rejects", """SELECT booking_id, reason FROM (SELECT booking_id, CASE WHEN NOT parsed THEN 'body:invalid_json'
  WHEN e <> '' THEN e WHEN NOT EXISTS (SELECT 1 FROM v_bookings b WHERE b.id = booking_id) THEN 'UNKNOWN_BOOKING'
  END AS reason FROM (SELECT booking_id, parsed, concat_ws(',',
    CASE WHEN COALESCE(booking_id, '') = '' THEN 'booking_id:required' END,
    CASE WHEN COALESCE(user_id, '') = '' THEN 'user_id:required' END,
    CASE WHEN COALESCE(event_id, '') = '' THEN 'event_id:required' END,
    CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'quantity:positive' END) AS e FROM pm))
WHERE reason IS NOT NULL""", {"pm": _PARSED_SQL})
def t1r(spark, sf):
    return _settled(spark, sf).rejects()


# every message for more than eight seats fails to be confirmed
_FAILS_OVER = 8
_SETTLES = {
    "pm": _PARSED_SQL,
    "v": """SELECT m.booking_id, m.ts, m.copy, CASE WHEN m.quantity > 8 THEN 'CANCELLED' ELSE 'CONFIRMED' END AS target
  FROM pm m JOIN v_bookings b ON b.id = m.booking_id
  WHERE m.parsed AND COALESCE(m.user_id, '') <> '' AND COALESCE(m.event_id, '') <> '' AND m.quantity > 0""",
    "ch": """SELECT booking_id, ts, target, COALESCE(lag(target) OVER (PARTITION BY booking_id ORDER BY ts, copy), 'PENDING')
  AS prev FROM v""",
    "t": """SELECT c.booking_id, b.event_id, b.quantity, CAST(b.unit_price_cents AS BIGINT) AS unit_price_cents,
  c.prev AS from_status, c.target AS to_status, c.ts FROM ch c JOIN v_bookings b ON b.id = c.booking_id
  WHERE c.prev <> c.target"""}


def _settled_or_cancelled(spark, sf):
    enable_state_store(spark)
    f = fx(spark, sf)
    base = f.bookings.withColumn("status", F.lit("PENDING"))
    msgs = _stored(f.booking_messages)
    run = SliceReplay(spark, "t1-settle-or-cancel")
    src, slices = _shuffled(msgs, "ts", "body", ORDER_DAYS)
    beat = _heartbeats(msgs, "ts", [{"copy": 0, "body": "~"}], beats=(ORDER_DAYS + 2,))
    run.run(src, "_slice", slices, lambda s: _append_to(run.sink)(S.settle_or_cancel(
        s, base, F.col("quantity") > _FAILS_OVER, f"{ORDER_DAYS + 1} days")), beat)
    return f, run, spark.read.parquet(run.sink)


@register("T1_settle_or_cancel", "SELECT * FROM t", _SETTLES)
def t1c(spark, sf):
    changes = _settled_or_cancelled(spark, sf)[2]
    return changes.where(F.col("reason").isNull()).drop("reason")


@register("T1_released_seats", """SELECT e.id, CAST(least(e.remaining + COALESCE(r.q, 0), e.capacity) AS INTEGER)
  AS remaining FROM v_events_stocked e LEFT JOIN (SELECT event_id, SUM(quantity) AS q FROM t
  WHERE to_status = 'CANCELLED' GROUP BY event_id) r ON r.event_id = e.id""", _SETTLES)
def t1s(spark, sf):
    f, _, changes = _settled_or_cancelled(spark, sf)
    return release_cancelled(f.events_stocked, changes).select("id", "remaining")


_DOC_CENTS = "SUM(CASE WHEN to_status = 'CONFIRMED' THEN 1 WHEN from_status = 'CONFIRMED' THEN -1 ELSE 0 END * {})"


@register("T1_stats_documents", f"""SELECT 'event:' || event_id || ':stats' AS key, event_id,
  '{{"revenue":' || CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR)
    WHEN c % 10 = 0 THEN CAST(c // 100 AS VARCHAR) || '.' || CAST(c % 100 // 10 AS VARCHAR)
    ELSE CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END
  || ',"tickets_sold":' || CAST(s AS VARCHAR) || '}}' AS value
FROM (SELECT event_id, CAST({_DOC_CENTS.format('quantity')} AS BIGINT) AS s,
  CAST({_DOC_CENTS.format('quantity * unit_price_cents')} AS BIGINT) AS c FROM t GROUP BY event_id)""", _SETTLES)
def t1d(spark, sf):
    _, _, changes = _settled_or_cancelled(spark, sf)
    docs = SliceReplay(spark, "t1-documents")
    src, slices = _sliced(changes)
    docs.run(src, "_slice", slices, lambda s: S.stats_stream(s, docs.sink))
    return S.latest_documents(spark.read.parquet(docs.sink).drop("_slice"))


# -------------------------------------------------------------------- T2
@register("T2_expire_pending", """SELECT c.booking_id, c.ts + INTERVAL 15 MINUTE AS expires_at
FROM v_commands c WHERE c.command = 'CREATE' AND NOT EXISTS (SELECT 1 FROM v_commands s
  WHERE s.booking_id = c.booking_id AND s.command <> 'CREATE' AND s.ts >= c.ts
  AND s.ts <= c.ts + INTERVAL 15 MINUTE)""")
def t2(spark, sf):
    enable_state_store(spark)
    cmds = _stored(fx(spark, sf).commands)
    run = SliceReplay(spark, "t2-expire")
    src, slices = _sliced(cmds)
    # end of stream: a booking created and confirmed at the same instant
    # moves both watermarks on and never expires itself
    beat = {"booking_id": lambda n: f"~heartbeat{n}", "event_id": "~", "quantity": 0}
    beats = _heartbeats(cmds, "ts", [dict(beat, seq=0, command="CREATE"), dict(beat, seq=1, command="CONFIRM")])
    run.run(src, "_slice", slices, lambda s: _append_to(run.sink)(S.expire_pending_stream(s)), extra=beats)
    return spark.read.parquet(run.sink)


@register("T2_expired_batch", """SELECT c.booking_id, c.ts + INTERVAL 15 MINUTE AS expires_at
FROM v_commands c WHERE c.command = 'CREATE' AND NOT EXISTS (SELECT 1 FROM v_commands s
  WHERE s.booking_id = c.booking_id AND s.command <> 'CREATE' AND s.ts >= c.ts
  AND s.ts <= c.ts + INTERVAL 15 MINUTE)""")
def t2b(spark, sf):
    return S.expired_bookings(fx(spark, sf).commands)


@register("T2_expiry_applied", """SELECT booking_id AS id, target AS status, ts AS updated_at FROM r2 WHERE n = 1""", {
    "x": """SELECT c.booking_id, c.ts + INTERVAL 15 MINUTE AS ts FROM v_commands c
  WHERE c.command = 'CREATE' AND NOT EXISTS (SELECT 1 FROM v_commands s
    WHERE s.booking_id = c.booking_id AND s.command <> 'CREATE' AND s.ts >= c.ts
    AND s.ts <= c.ts + INTERVAL 15 MINUTE)""",
    "u": """SELECT id AS booking_id, 'PENDING' AS target, created_at AS ts, 0 AS rk, 0 AS seq FROM v_bookings
  UNION ALL SELECT booking_id, CASE command WHEN 'CONFIRM' THEN 'CONFIRMED' ELSE 'CANCELLED' END, ts, 1, seq
  FROM v_commands WHERE command <> 'CREATE'
  UNION ALL SELECT booking_id, 'CANCELLED', ts, 1, 0 FROM x""",
    "l2": "SELECT *, lag(target) OVER (PARTITION BY booking_id ORDER BY rk, ts, seq) AS prev FROM u",
    "r2": """SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY rk DESC, ts DESC, seq DESC) AS n
  FROM l2 WHERE prev IS NULL OR prev <> target"""})
def t2a(spark, sf):
    f = fx(spark, sf)
    cmds = f.commands.where(F.col("command") != "CREATE")
    cancels = S.expiry_cancels(S.expired_bookings(f.commands), f.commands)
    created = f.bookings.withColumn("status", F.lit("PENDING")).withColumn("updated_at", F.col("created_at"))
    return apply_status(created, cmds.unionByName(cancels)).select("id", "status", "updated_at")


# -------------------------------------------------------------------- T3
@register("T3_admit_stream", """SELECT ev AS event_id, id, ok AS admitted, CAST(rem AS INTEGER) AS remaining,
  CASE WHEN ok THEN NULL ELSE 'NOT_ENOUGH_TICKETS' END AS reason FROM f""", W1_STEPS, recursive=True)
def t3(spark, sf):
    enable_state_store(spark)
    f = fx(spark, sf)
    req = _stored(f.bookings.select("id", "event_id", "quantity", "created_at"))
    run = SliceReplay(spark, "t3-admit")
    src, slices = _shuffled(req, "created_at", "id", ORDER_DAYS)
    ev = f.events.select("id", "capacity")
    beat = _heartbeats(req, "created_at", [{"id": "~", "event_id": "~", "quantity": 0}], beats=(ORDER_DAYS + 2,))
    run.run(src, "_slice", slices, lambda s: _append_to(run.sink)(S.admit_stream(s, ev, f"{ORDER_DAYS + 1} days")), beat)
    return spark.read.parquet(run.sink).select("event_id", "id", "admitted", "remaining", "reason")


# -------------------------------------------------------------------- T4
@register("T4_rate_limit_stream", """SELECT k.key, k.request_id, k.ts, f.ok AS allowed, CAST(f.tok AS BIGINT) AS tokens
FROM f JOIN k ON k.key = f.key AND k.rn = f.rn""", W7_STEPS, recursive=True)
def t4(spark, sf):
    enable_state_store(spark)
    log = fx(spark, sf).access
    run = SliceReplay(spark, "t4-rate")
    src, slices = _shuffled(log, "ts", "request_id", 2)
    beat = _heartbeats(log, "ts", [{c: "~" if c in ("client_ip", "request_id") else None for c in log.columns
                                    if c != "ts"}], beats=(4,))
    run.run(src, "_slice", slices, lambda s: _append_to(run.sink)(S.rate_limit_stream(
        s, "client_ip", TOKEN_US, BURST, delay="3 days", width_ms=86_400_000)), beat)  # hours lie between requests
    return spark.read.parquet(run.sink)


# -------------------------------------------------------------------- T5
# every confirmed booking was confirmed at its last change; a cancelled one was
# confirmed when created and cancelled then, so its seats come and go again
@register("T5_gauge_stream", """SELECT 'tickets_sold_total' AS metric, event_id,
  CAST(SUM(CASE WHEN status = 'CONFIRMED' THEN quantity ELSE 0 END) AS DOUBLE) AS value
FROM v_bookings WHERE status <> 'PENDING' GROUP BY event_id
UNION ALL SELECT 'revenue_total', event_id,
  CAST(SUM(CASE WHEN status = 'CONFIRMED' THEN CAST(quantity AS BIGINT) * unit_price_cents ELSE 0 END) AS DOUBLE) / 100.0
FROM v_bookings WHERE status <> 'PENDING' GROUP BY event_id""")
def t5(spark, sf):
    b = fx(spark, sf).bookings

    def change(start, end, at):
        return F.struct(F.lit(start).alias("from_status"), F.lit(end).alias("to_status"), F.col(at).alias("ts"))

    made, st = change(None, "PENDING", "created_at"), F.col("status")
    steps = F.when(st == "CONFIRMED", F.array(made, change("PENDING", "CONFIRMED", "updated_at"))).when(
        st == "CANCELLED", F.array(made, change("PENDING", "CONFIRMED", "created_at"),
                                   change("CONFIRMED", "CANCELLED", "updated_at"))).otherwise(F.array(made))
    changes = b.select("event_id", "quantity", "unit_price_cents", F.explode(steps).alias("c")).select(
        "event_id", "quantity", "unit_price_cents", "c.*")
    run = SliceReplay(spark, "t5-gauges")
    src, slices = _sliced(changes)
    run.run(src, "_slice", slices, lambda s: S.gauge_stream(s, run.sink))
    return S.latest_gauges(spark.read.parquet(run.sink))


# -------------------------------------------------------------------- T6
@register("T6_dedupe_messages", "SELECT DISTINCT booking_id, user_id, event_id, quantity FROM pm WHERE parsed",
          {"pm": _PARSED_SQL})
def t6(spark, sf):
    msgs = fx(spark, sf).booking_messages
    run = SliceReplay(spark, "t6-dedupe")
    src, slices = _sliced(msgs)

    def build(s):
        parsed = parse_booking_messages(s).where("parsed")
        out = S.dedupe_messages(parsed).select("booking_id", "user_id", "event_id", "quantity")
        return _append_to(run.sink)(out)

    run.run(src, "_slice", slices, build)
    return spark.read.parquet(run.sink)


@register("T6_dedupe_two_level", "SELECT DISTINCT booking_id, user_id, event_id, quantity FROM pm WHERE parsed",
          {"pm": _PARSED_SQL})
def t6k(spark, sf):
    msgs = fx(spark, sf).booking_messages
    run = SliceReplay(spark, "t6-two-level")
    src, slices = _shuffled(msgs, "ts", "body", ORDER_DAYS)
    sink = S.SeenKeys(spark, run.sink)
    # nothing is recent: every copy of another micro-batch is told by the stored keys
    run.run(src, "_slice", slices, lambda s: S.dedupe_stream(parse_booking_messages(s).where("parsed").select(
        "booking_id", "user_id", "event_id", "quantity"), sink, "0 seconds"))
    return sink.result()


# -------------------------------------------------------------------- T7
def _command_beat(commands, beats=1):
    return _heartbeats(commands, "ts", [{"booking_id": "~", "event_id": "~", "quantity": 0, "seq": 0,
                                         "command": "CREATE"}], beats=range(ORDER_DAYS + 2, ORDER_DAYS + 2 + beats))


@register("T7_release_stream", """SELECT k.ev AS event_id, k.b AS booking_id, k.seq, k.cm AS command, k.ts,
  f.ok AS applied, CAST(f.rem AS INTEGER) AS remaining
FROM f JOIN k ON k.ev = f.ev AND k.rn = f.rn""", W2_STEPS, recursive=True)
def t7(spark, sf):
    enable_state_store(spark)
    f = fx(spark, sf)
    run = SliceReplay(spark, "t7-inventory")
    cmds = _stored(f.commands)
    src, slices = _shuffled(cmds, "ts", "booking_id", ORDER_DAYS)
    ev = f.events.select("id", "capacity")
    run.run(src, "_slice", slices, lambda s: _append_to(run.sink)(S.inventory_stream(
        s, ev, f"{ORDER_DAYS + 1} days", keep="3650 days")), _command_beat(cmds))
    return spark.read.parquet(run.sink)


@register("T2_expiry_stream", """SELECT k.ev AS event_id, k.b AS booking_id, k.seq, k.cm AS command, k.ts,
  f.ok AS applied, CAST(f.rem AS INTEGER) AS remaining
FROM f JOIN k ON k.ev = f.ev AND k.rn = f.rn WHERE f.ok OR k.seq > 0 OR k.cm = 'CREATE'""", {
    "x": """SELECT c.booking_id, c.event_id, c.quantity, c.ts + INTERVAL 15 MINUTE AS ts, 0 AS seq, 'CANCEL' AS command
  FROM v_commands c WHERE c.command = 'CREATE' AND NOT EXISTS (SELECT 1 FROM v_commands s
    WHERE s.booking_id = c.booking_id AND s.command <> 'CREATE' AND s.ts >= c.ts
    AND s.ts <= c.ts + INTERVAL 15 MINUTE)""",
    "vx": """SELECT booking_id, event_id, quantity, ts, seq, command FROM v_commands
  UNION ALL SELECT booking_id, event_id, quantity, ts, seq, command FROM x""",
    **{k: v.replace("v_commands", "vx") for k, v in W2_STEPS.items()}}, recursive=True)
def t2x(spark, sf):
    enable_state_store(spark)
    f = fx(spark, sf)
    # the deadlines of bookings released by the first beat are timers of the next batch
    run = SliceReplay(spark, "t2-expiry")
    cmds = _stored(f.commands)
    src, slices = _shuffled(cmds, "ts", "booking_id", ORDER_DAYS)
    ev = f.events.select("id", "capacity")
    run.run(src, "_slice", slices, lambda s: _append_to(run.sink)(S.inventory_stream(
        s, ev, f"{ORDER_DAYS + 1} days", ttl="15 minutes")), _command_beat(cmds, beats=2))
    return spark.read.parquet(run.sink)


# -------------------------------------------------------------------- T8
# arrival: most requests on time, every 50th two days late; delivered in
# five-day slices of arrival time
_ARRIVAL = {"a": """SELECT request_id, ts, CAST(floor((epoch(ts + CASE WHEN CAST(request_id AS BIGINT) % 50 = 0
    THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 432000) AS INTEGER) AS slice
FROM v_access""",
            "m": "SELECT slice, MAX(ts) AS mx FROM a GROUP BY slice",
            "wm": "SELECT DISTINCT a.slice, (SELECT MAX(m.mx) FROM m WHERE m.slice < a.slice) AS prev_max FROM a"}


@register("T8_late_rows", """SELECT a.request_id, a.ts FROM a JOIN wm ON wm.slice = a.slice
WHERE a.ts < wm.prev_max - INTERVAL 15 MINUTE""", _ARRIVAL)
def t8(spark, sf):
    log = fx(spark, sf).access.select("request_id", "ts")
    late = F.when(F.col("request_id").cast("bigint") % 50 == 0, F.make_dt_interval(F.lit(2), F.lit(0), F.lit(0),
                                                                                   F.lit(0)))
    arrival = F.col("ts") + F.coalesce(late, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    src = log.withColumn("_slice", F.floor((F.unix_micros(arrival.cast("timestamp")) - start)
                                           / F.lit(432_000 * 1_000_000)).cast("int"))
    last = src.agg(F.max("_slice")).first()[0]
    run = SliceReplay(spark, "t8-late")
    run.run(src, "_slice", list(range(last + 1)), lambda s: S.log_arrivals(s, run.sink))
    arrivals = spark.read.schema("request_id string, ts timestamp_ntz, batch_id int").parquet(run.sink)
    return S.split_late(arrivals, run.watermarks())[0].select("request_id", "ts")


# ------------------------------------------------ A7 / J6 over live counters
@register("J6_live_counters", """SELECT event_id, counter_remaining, table_remaining, side, difference FROM (
SELECT COALESCE(c.id, e.id) AS event_id, c.counter_remaining, e.remaining AS table_remaining,
  CASE WHEN c.counter_remaining IS NULL THEN 'table_only' WHEN e.remaining IS NULL THEN 'counter_only'
       ELSE 'both' END AS side,
  CAST(c.counter_remaining - e.remaining AS INTEGER) AS difference
FROM c FULL OUTER JOIN v_events_stocked e ON c.id = e.id) WHERE side <> 'both' OR difference <> 0""", {
    **W1_STEPS, "c": """SELECT e.id, CAST(COALESCE(l.rem, e.capacity) AS INTEGER) AS counter_remaining
  FROM v_events e LEFT JOIN (SELECT ev, arg_max(rem, rn) AS rem FROM f GROUP BY ev) l ON l.ev = e.id"""}, recursive=True)
def j6live(spark, sf):
    enable_state_store(spark)
    f = fx(spark, sf)
    req = _stored(f.bookings.select("id", "event_id", "quantity", "created_at"))
    run = SliceReplay(spark, "j6-live")
    src, slices = _sliced(req, "created_at", 2)
    ev = f.events.select("id", "capacity")
    beat = _heartbeats(req, "created_at", [{"id": "~", "event_id": "~", "quantity": 0}])
    run.run(src, "_slice", slices, lambda s: _append_to(run.sink)(S.admit_stream(s, ev)), beat)
    return inventory_drift(S.live_counters(spark, run.checkpoint), f.events_stocked)
