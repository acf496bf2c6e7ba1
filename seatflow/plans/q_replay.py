"""Registered queries for the ordered replays (W1-W7).  Oracles step row by
row per key with DuckDB recursive CTEs, an independent formulation of the
same rules."""

from __future__ import annotations

from seatflow.operators import replay as W
from seatflow.plans.catalog import fx, register

# ------------------------------------------------------------------- W1
W1_STEPS = {
    "k": """SELECT b.event_id AS ev, b.id, b.quantity AS q, e.capacity AS cap,
  row_number() OVER (PARTITION BY b.event_id ORDER BY b.created_at, b.id) AS rn
FROM v_bookings b JOIN v_events e ON e.id = b.event_id""",
    "f": """SELECT ev, id, rn, q <= cap AS ok, cap - CASE WHEN q <= cap THEN q ELSE 0 END AS rem FROM k WHERE rn = 1
  UNION ALL
  SELECT k.ev, k.id, k.rn, k.q <= f.rem, f.rem - CASE WHEN k.q <= f.rem THEN k.q ELSE 0 END
  FROM f JOIN k ON k.ev = f.ev AND k.rn = f.rn + 1""",
}


@register("W1_admit", """SELECT ev AS event_id, id, ok AS admitted, CAST(rem AS INTEGER) AS remaining,
  CASE WHEN ok THEN NULL ELSE 'NOT_ENOUGH_TICKETS' END AS reason FROM f""", W1_STEPS, recursive=True)
def w1(spark, sf):
    f = fx(spark, sf)
    req = f.bookings.select("id", "event_id", "quantity", "created_at")
    return W.admit(req, f.events).select("event_id", "id", "admitted", "remaining", "reason")


# ------------------------------------------------------------------- W2
W2_STEPS = {
    "k": """SELECT c.event_id AS ev, c.booking_id AS b, c.quantity AS q, c.command AS cm, e.capacity AS cap,
  c.seq, c.ts, row_number() OVER (PARTITION BY c.event_id ORDER BY c.ts, c.booking_id, c.seq) AS rn
FROM v_commands c JOIN v_events e ON e.id = c.event_id""",
    "f": """SELECT ev, CAST(0 AS BIGINT) AS rn, cap AS rem, []::VARCHAR[] AS held, []::VARCHAR[] AS gone, cap,
    false AS ok
  FROM (SELECT DISTINCT ev, cap FROM k)
  UNION ALL
  SELECT f.ev, k.rn,
    CASE WHEN k.cm = 'CREATE' AND k.q <= f.rem THEN f.rem - k.q
         WHEN k.cm = 'CANCEL' AND list_contains(f.held, k.b) THEN least(f.rem + k.q, f.cap) ELSE f.rem END,
    CASE WHEN (k.cm = 'CREATE' AND k.q <= f.rem) OR (k.cm = 'CONFIRM' AND list_contains(f.gone, k.b))
           THEN list_append(f.held, k.b)
         WHEN k.cm = 'CANCEL' THEN list_filter(f.held, lambda x: x <> k.b) ELSE f.held END,
    CASE WHEN k.cm = 'CANCEL' AND list_contains(f.held, k.b) THEN list_append(f.gone, k.b)
         WHEN k.cm = 'CONFIRM' THEN list_filter(f.gone, lambda x: x <> k.b) ELSE f.gone END,
    f.cap,
    CASE WHEN k.cm = 'CREATE' THEN k.q <= f.rem WHEN k.cm = 'CANCEL' THEN list_contains(f.held, k.b)
         ELSE list_contains(f.gone, k.b) END
  FROM f JOIN k ON k.ev = f.ev AND k.rn = f.rn + 1""",
}


@register("W2_replay_inventory", """SELECT k.ev AS event_id, k.b AS booking_id, k.seq, k.cm AS command, k.ts,
  f.ok AS applied, CAST(f.rem AS INTEGER) AS remaining
FROM f JOIN k ON k.ev = f.ev AND k.rn = f.rn""", W2_STEPS, recursive=True)
def w2(spark, sf):
    f = fx(spark, sf)
    return W.replay_inventory(f.commands, f.events)


# ------------------------------------------------------------------- W3-W5
_TRANSITIONS = {
    "t": """SELECT booking_id, event_id, quantity, ts, seq, command,
  CASE command WHEN 'CREATE' THEN 'PENDING' WHEN 'CONFIRM' THEN 'CONFIRMED' ELSE 'CANCELLED' END AS to_status
FROM v_commands""",
    "l": "SELECT *, lag(to_status) OVER (PARTITION BY booking_id ORDER BY ts, seq) AS from_status FROM t",
    "r": """SELECT booking_id, event_id, quantity, ts, seq, command, to_status, from_status,
  from_status IS NOT NULL AND from_status <> 'PENDING' AS illegal
FROM l WHERE from_status IS NULL OR from_status <> to_status""",
    "last": """SELECT booking_id, to_status AS status, ts AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, seq DESC) AS n FROM r) WHERE n = 1""",
}


@register("W3_status_transitions", "SELECT * FROM r", _TRANSITIONS)
def w3(spark, sf):
    return W.status_transitions(fx(spark, sf).commands)


@register("W4_current_status", "SELECT * FROM last", _TRANSITIONS)
def w4(spark, sf):
    return W.current_status(W.status_transitions(fx(spark, sf).commands))


@register("W5_oversold_after_reconfirm", """SELECT per.event_id, confirmed_seats, reconfirmed_seats, e.capacity,
  confirmed_seats > e.capacity AS over_capacity
FROM per JOIN v_events e ON e.id = per.event_id WHERE reconfirmed_seats > 0""", dict(_TRANSITIONS, **{
    "re": """SELECT booking_id, any_value(event_id) AS event_id, any_value(quantity) AS quantity,
  max(CASE WHEN from_status = 'CANCELLED' AND to_status = 'CONFIRMED' THEN 1 ELSE 0 END) AS re
FROM r GROUP BY booking_id""",
    "per": """SELECT re.event_id, CAST(SUM(re.quantity) AS BIGINT) AS confirmed_seats,
  CAST(SUM(CASE WHEN re.re = 1 THEN re.quantity ELSE 0 END) AS BIGINT) AS reconfirmed_seats
FROM re JOIN last ON last.booking_id = re.booking_id WHERE last.status = 'CONFIRMED' GROUP BY re.event_id"""}))
def w5(spark, sf):
    f = fx(spark, sf)
    return W.oversold_after_reconfirm(W.status_transitions(f.commands), f.events)


# ------------------------------------------------------------------- W6
@register("W6_gauge_series", """SELECT event_id, bucket, tickets, revenue_cents,
  CAST(SUM(tickets) OVER (PARTITION BY event_id ORDER BY bucket) AS BIGINT) AS tickets_total,
  CAST(SUM(revenue_cents) OVER (PARTITION BY event_id ORDER BY bucket) AS BIGINT) AS revenue_cents_total
FROM (SELECT event_id, date_trunc('day', updated_at) AS bucket, CAST(SUM(quantity) AS BIGINT) AS tickets,
  CAST(SUM(CAST(quantity AS BIGINT) * unit_price_cents) AS BIGINT) AS revenue_cents
  FROM v_bookings WHERE status = 'CONFIRMED' GROUP BY event_id, date_trunc('day', updated_at))""")
def w6(spark, sf):
    return W.gauge_series(fx(spark, sf).bookings, "1 day")


# at the interval at which the gauges are scraped (epoch-aligned, as Spark's window)
_S15 = "CAST(to_timestamp(floor(epoch(updated_at) / 15) * 15) AT TIME ZONE 'UTC' AS TIMESTAMP)"


@register("W6_gauge_series_15s", f"""SELECT event_id, bucket, tickets, revenue_cents,
  CAST(SUM(tickets) OVER (PARTITION BY event_id ORDER BY bucket) AS BIGINT) AS tickets_total,
  CAST(SUM(revenue_cents) OVER (PARTITION BY event_id ORDER BY bucket) AS BIGINT) AS revenue_cents_total
FROM (SELECT event_id, {_S15} AS bucket, CAST(SUM(quantity) AS BIGINT) AS tickets,
  CAST(SUM(CAST(quantity AS BIGINT) * unit_price_cents) AS BIGINT) AS revenue_cents
  FROM v_bookings WHERE status = 'CONFIRMED' GROUP BY event_id, {_S15})""")
def w6s(spark, sf):
    return W.gauge_series(fx(spark, sf).bookings, "15 seconds")


# the filled series uses 30-day buckets (epoch-aligned, as Spark's window)
_B30 = "CAST(to_timestamp(floor(epoch(updated_at) / 2592000) * 2592000) AT TIME ZONE 'UTC' AS TIMESTAMP)"


@register("W6_gauge_series_filled", """SELECT g.event_id, g.bucket, COALESCE(p.tickets, 0) AS tickets,
  COALESCE(p.revenue_cents, 0) AS revenue_cents,
  CAST(SUM(COALESCE(p.tickets, 0)) OVER (PARTITION BY g.event_id ORDER BY g.bucket) AS BIGINT) AS tickets_total,
  CAST(SUM(COALESCE(p.revenue_cents, 0)) OVER (PARTITION BY g.event_id ORDER BY g.bucket) AS BIGINT)
    AS revenue_cents_total
FROM g LEFT JOIN p ON p.event_id = g.event_id AND p.bucket = g.bucket""", {
    "p": f"""SELECT event_id, {_B30} AS bucket, CAST(SUM(quantity) AS BIGINT) AS tickets,
  CAST(SUM(CAST(quantity AS BIGINT) * unit_price_cents) AS BIGINT) AS revenue_cents
FROM v_bookings WHERE status = 'CONFIRMED' GROUP BY event_id, {_B30}""",
    "g": """SELECT event_id, unnest(generate_series(MIN(bucket), MAX(bucket), INTERVAL 30 DAY)) AS bucket
FROM p GROUP BY event_id"""})
def w6f(spark, sf):
    return W.gauge_series(fx(spark, sf).bookings, "30 days", fill=True)


# ------------------------------------------------------------------- W7
# scaled plan for the fixture log (one token per 4 hours, burst 2): the
# service's 2/s plan never refuses on requests hours apart
TOKEN_US, BURST = 14_400_000_000, 2

W7_STEPS = {
    "k": """SELECT client_ip AS key, request_id, ts, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY client_ip ORDER BY ts, request_id) AS rn FROM v_access""",
    "f": f"""SELECT key, rn, us, CAST({BURST} * {TOKEN_US} - {TOKEN_US} AS BIGINT) AS tok, true AS ok
  FROM k WHERE rn = 1
  UNION ALL
  SELECT k.key, k.rn, k.us,
    least({BURST} * {TOKEN_US}, f.tok + (k.us - f.us))
      - CASE WHEN least({BURST} * {TOKEN_US}, f.tok + (k.us - f.us)) >= {TOKEN_US} THEN {TOKEN_US} ELSE 0 END,
    least({BURST} * {TOKEN_US}, f.tok + (k.us - f.us)) >= {TOKEN_US}
  FROM f JOIN k ON k.key = f.key AND k.rn = f.rn + 1""",
}


@register("W7_replay_rate_limit", """SELECT k.key, k.request_id, k.ts, f.ok AS allowed, CAST(f.tok AS BIGINT) AS tokens
FROM f JOIN k ON k.key = f.key AND k.rn = f.rn""", W7_STEPS, recursive=True)
def w7(spark, sf):
    return W.replay_rate_limit(fx(spark, sf).access, "client_ip", TOKEN_US, BURST)
