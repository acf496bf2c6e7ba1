"""Registered queries for sources, selections, checks, joins, aggregates
and ordered listing (S, P, J, A, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatflow.operators import joins as J
from seatflow.operators import select as P
from seatflow.operators import stats as A
from seatflow.operators import validate as V
from seatflow.plans.catalog import AS_OF, GAUGE_AT, PENDING_CUTOFF, fx, register
from seatflow.sources.documents import gauge_samples, stats_documents
from seatflow.sources.messages import booking_messages, parse_booking_messages
from seatflow.sources.tables import conform, parse_access_lines

# ---------------------------------------------------------------- oracle text
# error text of a check: names of the failed rules joined by commas
_SEP = "','"


def _errors(*cases: str) -> str:
    return "concat_ws(" + _SEP + ", " + ", ".join(cases) + ")"


_CURRENCY = """CASE WHEN {c} % 100 = 0 THEN CAST({c} // 100 AS VARCHAR)
  WHEN {c} % 10 = 0 THEN CAST({c} // 100 AS VARCHAR) || '.' || CAST(({c} % 100) // 10 AS VARCHAR)
  ELSE CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0') END"""

_CONFIRMED_TOTALS = """SELECT event_id, CAST(SUM(quantity) AS BIGINT) AS tickets_sold,
  CAST(SUM(CAST(quantity AS BIGINT) * unit_price_cents) AS BIGINT) AS revenue_cents
FROM v_bookings WHERE status = 'CONFIRMED' GROUP BY event_id"""

_STATS = {"t": _CONFIRMED_TOTALS, "st": """SELECT e.id AS event_id,
  CAST(COALESCE(t.tickets_sold, 0) AS BIGINT) AS tickets_sold,
  CAST(COALESCE(t.revenue_cents, 0) AS BIGINT) AS revenue_cents,
  CAST(COALESCE(t.revenue_cents, 0) AS DOUBLE) / 100.0 AS revenue
FROM v_events e LEFT JOIN t ON t.event_id = e.id"""}

_PARSED = """SELECT *, json_valid(body) AS parsed,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.booking_id') END AS booking_id,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.user_id') END AS user_id,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.event_id') END AS event_id,
  CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.quantity') AS INTEGER) END AS quantity
FROM {src}"""


def _level(status: str = "status") -> str:
    return f"CASE WHEN {status} >= 500 THEN 'error' WHEN {status} >= 400 THEN 'warn' ELSE 'info' END"


def _errtext(df):
    return df.withColumn("valid", F.size("errors") == 0).withColumn("errors", F.concat_ws(",", "errors"))


# ------------------------------------------------------------------ sources
@register("S1_read_bookings", """SELECT id, user_id, event_id, quantity, unit_price_cents, status, created_at,
  updated_at FROM v_bookings""")
def s1(spark, sf):
    return conform(fx(spark, sf).bookings, "bookings")


@register("S3_parse_messages", "SELECT offset_id, ts, body, parsed, booking_id, user_id, event_id, quantity FROM pm",
          {"pm": _PARSED.format(src="v_messages")})
def s3(spark, sf):
    return parse_booking_messages(fx(spark, sf).messages)


@register("S4_booking_messages", """SELECT id AS booking_id, 'booking.created' AS routing_key,
  '{"booking_id":"' || id || '","user_id":"' || user_id || '","event_id":"' || event_id || '","quantity":'
  || CAST(quantity AS VARCHAR) || '}' AS body FROM v_bookings""")
def s4(spark, sf):
    return booking_messages(fx(spark, sf).bookings)


@register("S5_read_access_log", f"""SELECT request_id, date_trunc('millisecond', ts) AS ts, {_level()} AS level, method, path, status,
  latency_ms, client_ip, user_id FROM v_access""")
def s5(spark, sf):
    log = parse_access_lines(fx(spark, sf).access_lines)
    return log.select("request_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "method", "path",
                      "status", "latency_ms", "client_ip", "user_id")


@register("S6_stats_documents", """SELECT 'event:' || event_id || ':stats' AS key, event_id,
  '{"revenue":' || """ + _CURRENCY.format(c="revenue_cents") + """ || ',"tickets_sold":'
  || CAST(tickets_sold AS VARCHAR) || '}' AS value FROM st""", _STATS)
def s6(spark, sf):
    f = fx(spark, sf)
    return stats_documents(A.event_stats(f.events, f.bookings))


@register("S7_gauge_samples", f"""SELECT 'tickets_sold_total' AS metric, event_id, CAST(tickets_sold AS DOUBLE) AS value,
  TIMESTAMP '{GAUGE_AT}' AS ts FROM st
UNION ALL SELECT 'revenue_total', event_id, revenue, TIMESTAMP '{GAUGE_AT}' FROM st""", _STATS)
def s7(spark, sf):
    f = fx(spark, sf)
    return gauge_samples(A.event_stats(f.events, f.bookings), F.lit(GAUGE_AT).cast("timestamp_ntz"))


# -------------------------------------------------------- lookups, filters
@register("P1_lookup", """SELECT id, user_id, event_id, status FROM v_bookings
WHERE id IN (SELECT booking_id FROM pm WHERE parsed)""", {"pm": _PARSED.format(src="v_booking_messages")})
def p1(spark, sf):
    f = fx(spark, sf)
    ids = parse_booking_messages(f.booking_messages).where("parsed").select("booking_id")
    return P.lookup(f.bookings.select("id", "user_id", "event_id", "status"), ids)


@register("P1_missing_ids", """SELECT DISTINCT event_id AS id FROM v_orphan_bookings
WHERE event_id NOT IN (SELECT id FROM v_events)""")
def p1m(spark, sf):
    f = fx(spark, sf)
    return P.missing_ids(f.events, f.orphan_bookings.select("event_id"))


@register("P2_lookup_by_email", """SELECT id, email, role FROM v_users
WHERE email IN (SELECT email FROM v_registrations)""")
def p2(spark, sf):
    f = fx(spark, sf)
    return P.lookup_by_email(f.users.select("id", "email", "role"), f.registrations)


@register("P3_event_cards", """SELECT id, name, description, starts_at AS date_time, capacity AS total_tickets,
  CAST(ticket_price_cents AS DOUBLE) / 100.0 AS ticket_price, remaining FROM v_events_stocked""")
def p3(spark, sf):
    return P.event_cards(fx(spark, sf).events_stocked)


@register("P4_booking_cards", "SELECT id, event_id, user_id, quantity, status FROM v_bookings")
def p4(spark, sf):
    return P.booking_cards(fx(spark, sf).bookings)


@register("P5_confirmed_by_event", """SELECT id, event_id, quantity FROM v_bookings
WHERE status = 'CONFIRMED' AND event_id IN (SELECT id FROM v_event_patches)""")
def p5(spark, sf):
    f = fx(spark, sf)
    return P.confirmed_by_event(f.bookings, f.event_patches.select("id")).select("id", "event_id", "quantity")


@register("P6_pending_older_than", f"""SELECT id, event_id, created_at FROM v_bookings
WHERE status = 'PENDING' AND created_at < TIMESTAMP '{PENDING_CUTOFF[:10]} {PENDING_CUTOFF[11:19]}'""")
def p6(spark, sf):
    return P.pending_older_than(fx(spark, sf).bookings, PENDING_CUTOFF).select("id", "event_id", "created_at")


@register("P7_split_by_start", f"""SELECT id, starts_at,
  CASE WHEN starts_at > TIMESTAMP '{AS_OF[:10]} {AS_OF[11:19]}' THEN 'upcoming' ELSE 'past' END AS phase
FROM v_events""")
def p7(spark, sf):
    return P.split_by_start(fx(spark, sf).events, AS_OF).select("id", "starts_at", "phase")


_UUID4 = r"'^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'"


@register("P8_validate_bookings", "SELECT id, errors, errors = '' AS valid FROM (SELECT id, " + _errors(
    "CASE WHEN COALESCE(event_id, '') = '' THEN 'event_id:required' END",
    f"CASE WHEN COALESCE(event_id, '') <> '' AND NOT regexp_matches(event_id, {_UUID4}) THEN 'event_id:uuid4' END",
    "CASE WHEN COALESCE(quantity, 0) = 0 THEN 'quantity:required' END",
    "CASE WHEN COALESCE(quantity, 0) <> 0 AND quantity < 1 THEN 'quantity:min' END",
    "CASE WHEN COALESCE(quantity, 0) <> 0 AND quantity > 10 THEN 'quantity:max' END",
    "CASE WHEN COALESCE(user_id, '') = '' THEN 'user_id:required' END") + " AS errors FROM v_uuid_requests)")
def p8(spark, sf):
    return _errtext(V.validate_bookings(fx(spark, sf).uuid_requests)).select("id", "errors", "valid")


@register("P9_validate_new_events", "SELECT id, errors, errors = '' AS valid FROM (SELECT id, " + _errors(
    "CASE WHEN COALESCE(name, '') = '' THEN 'name:required' END",
    "CASE WHEN COALESCE(capacity, 0) = 0 THEN 'capacity:required' END",
    "CASE WHEN COALESCE(capacity, 0) <> 0 AND capacity < 1 THEN 'capacity:min' END",
    "CASE WHEN COALESCE(ticket_price_cents, 0) = 0 THEN 'ticket_price_cents:required' END",
    "CASE WHEN COALESCE(ticket_price_cents, 0) <> 0 AND ticket_price_cents < 0 THEN 'ticket_price_cents:min' END",
) + " AS errors FROM v_new_events)")
def p9(spark, sf):
    return _errtext(V.validate_new_events(fx(spark, sf).new_events)).select("id", "errors", "valid")


@register("P10_validate_event_patches", "SELECT id, errors, errors = '' AS valid FROM (SELECT id, " + _errors(
    "CASE WHEN capacity < 0 THEN 'capacity:gte' END",
    "CASE WHEN ticket_price_cents < 0 THEN 'ticket_price_cents:gte' END") + " AS errors FROM v_event_patches)")
def p10(spark, sf):
    return _errtext(V.validate_event_patches(fx(spark, sf).event_patches)).select("id", "errors", "valid")


@register("P11_validate_messages", """SELECT offset_id, errors, errors = '' AS valid FROM (SELECT offset_id,
  CASE WHEN NOT parsed THEN 'body:invalid_json' ELSE """ + _errors(
    "CASE WHEN COALESCE(booking_id, '') = '' THEN 'booking_id:required' END",
    "CASE WHEN COALESCE(user_id, '') = '' THEN 'user_id:required' END",
    "CASE WHEN COALESCE(event_id, '') = '' THEN 'event_id:required' END",
    "CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'quantity:positive' END") + " END AS errors FROM pm)",
          {"pm": _PARSED.format(src="v_messages")})
def p11(spark, sf):
    parsed = parse_booking_messages(fx(spark, sf).messages)
    return _errtext(V.validate_messages(parsed)).select("offset_id", "errors", "valid")


_EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"


@register("P12_validate_registrations", "SELECT request_id, errors, errors = '' AS valid FROM (SELECT request_id, "
          + _errors(
              "CASE WHEN COALESCE(email, '') = '' THEN 'email:required' END",
              f"CASE WHEN COALESCE(email, '') <> '' AND NOT regexp_matches(email, {_EMAIL}) THEN 'email:email' END",
              "CASE WHEN COALESCE(password_length, 0) = 0 THEN 'password:required' END",
              "CASE WHEN COALESCE(password_length, 0) <> 0 AND password_length < 8 THEN 'password:min' END",
              "CASE WHEN COALESCE(password_length, 0) <> 0 AND password_length > 64 THEN 'password:max' END")
          + " AS errors FROM v_registrations)")
def p12(spark, sf):
    return _errtext(V.validate_registrations(fx(spark, sf).registrations)).select("request_id", "errors", "valid")


@register("P12_validate_profiles", "SELECT target_id, errors, errors = '' AS valid FROM (SELECT target_id, " + _errors(
    "CASE WHEN COALESCE(full_name, '') <> '' AND length(full_name) < 2 THEN 'full_name:min' END",
    "CASE WHEN COALESCE(full_name, '') <> '' AND length(full_name) > 100 THEN 'full_name:max' END")
          + " AS errors FROM v_profile_patches)")
def p12p(spark, sf):
    return _errtext(V.validate_profiles(fx(spark, sf).profile_patches)).select("target_id", "errors", "valid")


@register("P13_filter_by_role", """SELECT id, role,
  CASE WHEN COALESCE(role, '') = '' THEN 'NO_ROLE' WHEN role NOT IN ('ADMIN') THEN 'FORBIDDEN' END AS reason,
  COALESCE(role, '') IN ('ADMIN') AS allowed FROM v_users""")
def p13(spark, sf):
    return P.filter_by_role(fx(spark, sf).users.select("id", "role"), ["ADMIN"])


@register("P14_filter_own_rows", """SELECT target_id, caller_id,
  CASE WHEN COALESCE(caller_id, '') = '' THEN 'UNAUTHORIZED' WHEN caller_id <> target_id THEN 'FORBIDDEN' END
    AS reason,
  COALESCE(caller_id, '') <> '' AND caller_id = target_id AS allowed FROM v_profile_patches""")
def p14(spark, sf):
    return P.filter_own_rows(fx(spark, sf).profile_patches.select("target_id", "caller_id"))


# -------------------------------------------------------------------- joins
@register("J1_capture_price", """SELECT r.id, r.event_id, r.created_at, p.ticket_price_cents AS unit_price_cents
FROM v_requests r ASOF LEFT JOIN v_prices p ON r.event_id = p.event_id AND r.created_at >= p.valid_from""")
def j1(spark, sf):
    f = fx(spark, sf)
    return J.capture_price(f.requests.select("id", "event_id", "created_at"), f.prices)


_NK = """SELECT r.id AS request_id,
  CASE WHEN CAST(r.user_id AS BIGINT) % 9 = 0 THEN 'nobody' ELSE 'user' END || r.user_id || '@example.com' AS email,
  CASE WHEN CAST(r.event_id AS BIGINT) % 10 = 0 THEN e.name || ' (gone)' ELSE e.name END AS event_name
FROM v_requests r JOIN v_events e ON r.event_id = e.id"""


@register("J2_resolve_natural_keys", """SELECT n.request_id, n.email, n.event_name, u.id AS user_id, e.id AS event_id
FROM nk n LEFT JOIN v_users u ON u.email = n.email LEFT JOIN v_events e ON e.name = n.event_name""",
          {"nk": _NK})
def j2(spark, sf):
    f = fx(spark, sf)
    return J.resolve_natural_keys(f.natural_key_rows, f.users, f.events).select(
        "request_id", "email", "event_name", "user_id", "event_id")


@register("U1_user_id_by_email", """SELECT n.request_id, n.email, u.id AS user_id
FROM nk n LEFT JOIN v_users u ON u.email = n.email""", {"nk": _NK})
def u1(spark, sf):
    f = fx(spark, sf)
    return J.user_id_by_email(f.natural_key_rows.select("request_id", "email"), f.users)


@register("U2_event_id_by_name", """SELECT n.request_id, n.event_name, e.id AS event_id
FROM nk n LEFT JOIN v_events e ON e.name = n.event_name""", {"nk": _NK})
def u2(spark, sf):
    f = fx(spark, sf)
    return J.event_id_by_name(f.natural_key_rows.select("request_id", "event_name"), f.events)


@register("J3_remaining_confirmed", """SELECT e.id, CAST(e.capacity - COALESCE(t.tickets_sold, 0) AS INTEGER) AS remaining
FROM v_events e LEFT JOIN t ON t.event_id = e.id""", {"t": _CONFIRMED_TOTALS})
def j3(spark, sf):
    f = fx(spark, sf)
    return J.remaining_confirmed(f.events, f.bookings)


@register("J4_orphan_bookings", """SELECT id, user_id, event_id, quantity, status, 'MISSING_USER' AS reason
FROM v_orphan_bookings WHERE user_id NOT IN (SELECT id FROM v_users)
UNION ALL SELECT id, user_id, event_id, quantity, status, 'MISSING_EVENT'
FROM v_orphan_bookings WHERE event_id NOT IN (SELECT id FROM v_events)""")
def j4(spark, sf):
    f = fx(spark, sf)
    return J.orphan_bookings(f.orphan_bookings, f.users, f.events)


@register("J5_stats_existing_events", """SELECT event_id, tickets_sold, revenue_cents, revenue FROM st
WHERE event_id IN (SELECT event_id FROM v_orphan_bookings)""", _STATS)
def j5(spark, sf):
    f = fx(spark, sf)
    return J.stats_existing_events(f.orphan_bookings.select("event_id"), f.events, f.bookings)


_DRIFT = {"c": """SELECT substr(key, 17) AS event_id, remaining AS counter_remaining FROM v_counters
WHERE starts_with(key, 'event:remaining:')"""}


@register("J6_inventory_drift", """SELECT event_id, counter_remaining, table_remaining, side, difference FROM (
SELECT COALESCE(c.event_id, e.id) AS event_id, c.counter_remaining, e.remaining AS table_remaining,
  CASE WHEN c.counter_remaining IS NULL THEN 'table_only' WHEN e.remaining IS NULL THEN 'counter_only'
       ELSE 'both' END AS side,
  CAST(c.counter_remaining - e.remaining AS INTEGER) AS difference
FROM c FULL OUTER JOIN v_events_stocked e ON c.event_id = e.id)
WHERE side <> 'both' OR difference <> 0""", _DRIFT)
def j6(spark, sf):
    f = fx(spark, sf)
    return J.inventory_drift(f.counters, f.events_stocked)


@register("J7_unpublished_bookings", """SELECT id, user_id, event_id, status FROM v_bookings
WHERE id NOT IN (SELECT booking_id FROM pm WHERE parsed)""", {"pm": _PARSED.format(src="v_booking_messages")})
def j7(spark, sf):
    f = fx(spark, sf)
    msgs = parse_booking_messages(f.booking_messages)
    return J.unpublished_bookings(f.bookings.select("id", "user_id", "event_id", "status"), msgs)


# --------------------------------------------------------------- aggregates
@register("A1_tickets_sold", "SELECT event_id, tickets_sold FROM t", {"t": _CONFIRMED_TOTALS})
def a1(spark, sf):
    return A.tickets_sold(fx(spark, sf).bookings)


@register("A2_revenue_cents", "SELECT event_id, revenue_cents FROM t", {"t": _CONFIRMED_TOTALS})
def a2(spark, sf):
    return A.revenue_cents(fx(spark, sf).bookings)


@register("A3_event_stats", "SELECT event_id, tickets_sold, revenue_cents, revenue FROM st", _STATS)
def a3(spark, sf):
    f = fx(spark, sf)
    return A.event_stats(f.events, f.bookings)


@register("A4_gauge_stats", """SELECT event_id, CAST(tickets_sold AS DOUBLE) AS tickets_sold_total,
  revenue AS revenue_total FROM st""", _STATS)
def a4(spark, sf):
    f = fx(spark, sf)
    return A.gauge_stats(f.events, f.bookings)


_SUMMARY = {"sm": f"""SELECT
  (SELECT COUNT(*) FROM v_users) AS total_users,
  (SELECT COUNT(*) FROM v_users WHERE role = 'ADMIN') AS admin_users,
  (SELECT COUNT(*) FROM v_users WHERE role = 'USER') AS regular_users,
  (SELECT COUNT(*) FROM v_events) AS total_events,
  (SELECT COUNT(*) FROM v_events WHERE starts_at > TIMESTAMP '{AS_OF[:10]} {AS_OF[11:19]}') AS upcoming_events,
  (SELECT COUNT(*) FROM v_events WHERE starts_at <= TIMESTAMP '{AS_OF[:10]} {AS_OF[11:19]}') AS past_events,
  (SELECT COUNT(*) FROM v_bookings) AS total_bookings,
  (SELECT COUNT(*) FROM v_bookings WHERE status = 'CONFIRMED') AS confirmed_bookings,
  (SELECT COUNT(*) FROM v_bookings WHERE status = 'PENDING') AS pending_bookings,
  (SELECT COUNT(*) FROM v_bookings WHERE status = 'CANCELLED') AS cancelled_bookings"""}


@register("A5_data_summary", "SELECT * FROM sm", _SUMMARY)
def a5(spark, sf):
    f = fx(spark, sf)
    return A.data_summary(f.users, f.events, f.bookings, AS_OF)


@register("A6_data_summary_json", """SELECT '{"users":' || total_users || ',"admin_users":' || admin_users
  || ',"regular_users":' || regular_users || ',"events":' || total_events || ',"upcoming_events":' || upcoming_events
  || ',"past_events":' || past_events || ',"bookings":' || total_bookings || ',"confirmed_bookings":'
  || confirmed_bookings || ',"pending_bookings":' || pending_bookings || ',"cancelled_bookings":'
  || cancelled_bookings || '}' AS summary FROM sm""", _SUMMARY)
def a6(spark, sf):
    f = fx(spark, sf)
    return A.data_summary_json(f.users, f.events, f.bookings, AS_OF)


@register("A7_tracked_event_ids", "SELECT event_id FROM c", _DRIFT)
def a7(spark, sf):
    return A.tracked_event_ids(fx(spark, sf).counters)


@register("A8_duplicate_keys", """SELECT user_id, event_id, COUNT(*) AS n FROM v_bookings
GROUP BY user_id, event_id HAVING COUNT(*) > 1""")
def a8(spark, sf):
    return A.duplicate_keys(fx(spark, sf).bookings, ["user_id", "event_id"])


@register("A9_remaining_held", """SELECT e.id, CAST(e.capacity - COALESCE(h.held, 0) AS INTEGER) AS remaining
FROM v_events e LEFT JOIN (SELECT event_id, SUM(quantity) AS held FROM v_bookings
  WHERE status IN ('PENDING', 'CONFIRMED') GROUP BY event_id) h ON h.event_id = e.id""")
def a9(spark, sf):
    f = fx(spark, sf)
    return A.remaining_held(f.events, f.bookings)


@register("A10_access_severity", f"""SELECT path, {_level()} AS level, COUNT(*) AS requests,
  round(AVG(latency_ms), 6) AS avg_latency_ms, quantile_disc(latency_ms, 0.5) AS p50_latency_ms,
  MAX(latency_ms) AS max_latency_ms
FROM v_access GROUP BY path, level""")
def a10(spark, sf):
    return A.access_severity(parse_access_lines(fx(spark, sf).access_lines))


@register("A11_status_counts", """SELECT event_id, COUNT(*) FILTER (WHERE status = 'PENDING') AS pending,
  COUNT(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed,
  COUNT(*) FILTER (WHERE status = 'CANCELLED') AS cancelled
FROM v_bookings GROUP BY event_id""")
def a11(spark, sf):
    return A.status_counts(fx(spark, sf).bookings)


# ------------------------------------------------------------------ ordering
@register("O1_list_events", "SELECT id, name, starts_at FROM v_events ORDER BY starts_at, id")
def o1(spark, sf):
    return P.list_events(fx(spark, sf).events.select("id", "name", "starts_at"))


@register("O2_page_events", """SELECT id, name, starts_at FROM v_events ORDER BY starts_at, id
LIMIT 20 OFFSET 40""")
def o2(spark, sf):
    return P.page_events(fx(spark, sf).events.select("id", "name", "starts_at"), limit=20, offset=40)


@register("O2_page_events_deep", """SELECT id, name, starts_at FROM v_events ORDER BY starts_at, id
LIMIT 100 OFFSET 90""")
def o2_deep(spark, sf):
    return P.page_events(fx(spark, sf).events.select("id", "name", "starts_at"), limit=1000, offset="90")


@register("O2_page_events_after", """SELECT id, name, starts_at FROM v_events
WHERE starts_at > TIMESTAMP '1999-06-01 00:00:00' OR (starts_at = TIMESTAMP '1999-06-01 00:00:00' AND id > '5')
ORDER BY starts_at, id LIMIT 20""")
def o2_after(spark, sf):
    return P.page_events_after(fx(spark, sf).events.select("id", "name", "starts_at"), "1999-06-01T00:00:00Z", "5",
                               limit=20)
