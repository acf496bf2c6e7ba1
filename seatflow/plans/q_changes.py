"""Registered queries for the change sets."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from seatflow.operators import changes as C
from seatflow.operators.replay import status_transitions
from seatflow.plans.catalog import fx, register
from seatflow.plans.q_replay import _TRANSITIONS

# requests by uuid, some of the wrong version (P8 refuses them), W1 over the others
def _uuid(col: str, version: str = "'4'") -> str:
    return (f"substr(md5({col}), 1, 8) || '-' || substr(md5({col}), 9, 4) || '-' || {version} "
            f"|| substr(md5({col}), 14, 3) || '-a' || substr(md5({col}), 18, 3) || '-' || substr(md5({col}), 21, 12)")


_BOOK = {
    "ur": "SELECT id, user_id, quantity, created_at, event_id AS plain, CAST(event_id AS BIGINT) % 31 <> 0 AS v4, "
          + _uuid("event_id", "CASE WHEN CAST(event_id AS BIGINT) % 31 = 0 THEN '1' ELSE '4' END")
          + " AS event_id FROM v_requests",
    "ue": f"SELECT {_uuid('id')} AS id, capacity FROM v_events",
    "up": f"SELECT {_uuid('event_id')} AS event_id, valid_from, ticket_price_cents FROM v_prices",
    "k": """SELECT r.event_id AS ev, r.id, r.quantity AS q, e.capacity AS cap,
  row_number() OVER (PARTITION BY r.event_id ORDER BY r.created_at, r.id) AS rn
FROM ur r JOIN ue e ON e.id = r.event_id WHERE r.quantity BETWEEN 1 AND 10 AND r.v4""",
    "f": """SELECT ev, id, rn, q <= cap AS ok, cap - CASE WHEN q <= cap THEN q ELSE 0 END AS rem FROM k WHERE rn = 1
  UNION ALL
  SELECT k.ev, k.id, k.rn, k.q <= f.rem, f.rem - CASE WHEN k.q <= f.rem THEN k.q ELSE 0 END
  FROM f JOIN k ON k.ev = f.ev AND k.rn = f.rn + 1""",
    "adm": "SELECT r.id, r.user_id, r.event_id, r.quantity, r.created_at FROM ur r JOIN f ON f.id = r.id "
           "AND f.ev = r.event_id WHERE f.ok",
}


@lru_cache(maxsize=1)
def _decided(app: str, spark, sf):
    f = fx(spark, sf)
    return C.book_batch(f.uuid_requests, f.with_uuid(f.events_stocked, "id"), f.with_uuid(f.prices, "event_id"))


def _batch(spark, sf):
    """The four outputs of one batch read one decided table; the last batch of
    a session is kept, so their queries decide it once."""
    return _decided(spark.sparkContext.applicationId, spark, sf)


@register("C1_book_batch_bookings", """SELECT a.id, a.user_id, a.event_id, a.quantity,
  p.ticket_price_cents AS unit_price_cents, 'PENDING' AS status, a.created_at, a.created_at AS updated_at
FROM adm a ASOF LEFT JOIN up p ON a.event_id = p.event_id AND a.created_at >= p.valid_from""",
          _BOOK, recursive=True)
def c1b(spark, sf):
    return _batch(spark, sf).bookings


@register("C1_book_batch_events", """SELECT e.id, e.capacity,
  CAST(e.capacity - COALESCE(t.taken, 0) AS INTEGER) AS remaining
FROM ue e LEFT JOIN (SELECT f.ev, SUM(CASE WHEN f.ok THEN k.q ELSE 0 END) AS taken
  FROM f JOIN k ON k.ev = f.ev AND k.rn = f.rn GROUP BY f.ev) t ON t.ev = e.id""", _BOOK, recursive=True)
def c1e(spark, sf):
    return _batch(spark, sf).events.select("id", "capacity", "remaining")


@register("C1_book_batch_refusals", """SELECT id, reason FROM (SELECT id, concat_ws(',',
    CASE WHEN COALESCE(event_id, '') = '' THEN 'event_id:required' END,
    CASE WHEN NOT v4 THEN 'event_id:uuid4' END,
    CASE WHEN COALESCE(quantity, 0) = 0 THEN 'quantity:required' END,
    CASE WHEN COALESCE(quantity, 0) <> 0 AND quantity < 1 THEN 'quantity:min' END,
    CASE WHEN COALESCE(quantity, 0) <> 0 AND quantity > 10 THEN 'quantity:max' END,
    CASE WHEN COALESCE(user_id, '') = '' THEN 'user_id:required' END) AS reason FROM ur)
WHERE reason <> ''
UNION ALL SELECT id, 'NOT_ENOUGH_TICKETS' FROM f WHERE NOT ok""", _BOOK, recursive=True)
def c1r(spark, sf):
    return _batch(spark, sf).refusals.select("id", "reason")


@register("C1_book_batch_messages", """SELECT id AS booking_id, 'booking.created' AS routing_key,
  '{"booking_id":"' || id || '","user_id":"' || user_id || '","event_id":"' || event_id || '","quantity":'
  || CAST(quantity AS VARCHAR) || '}' AS body FROM adm""", _BOOK, recursive=True)
def c1m(spark, sf):
    return _batch(spark, sf).messages


@register("C2_apply_status", """SELECT booking_id AS id, target AS status, ts AS updated_at FROM r2 WHERE n = 1""", {
    "u": """SELECT id AS booking_id, 'PENDING' AS target, created_at AS ts, 0 AS rk, 0 AS seq FROM v_bookings
  UNION ALL SELECT booking_id, CASE command WHEN 'CONFIRM' THEN 'CONFIRMED' ELSE 'CANCELLED' END, ts, 1, seq
  FROM v_commands WHERE command <> 'CREATE'""",
    "l2": "SELECT *, lag(target) OVER (PARTITION BY booking_id ORDER BY rk, ts, seq) AS prev FROM u",
    "r2": """SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY rk DESC, ts DESC, seq DESC) AS n
  FROM l2 WHERE prev IS NULL OR prev <> target"""})
def c2(spark, sf):
    f = fx(spark, sf)
    created = f.bookings.withColumn("status", F.lit("PENDING")).withColumn("updated_at", F.col("created_at"))
    return C.apply_status(created, f.commands).select("id", "status", "updated_at")


@register("C3_release_cancelled", """SELECT e.id, e.capacity,
  CAST(least(e.capacity // 2 + COALESCE(b.back, 0), e.capacity) AS INTEGER) AS remaining
FROM v_events e LEFT JOIN (SELECT event_id, SUM(quantity) AS back FROM r WHERE to_status = 'CANCELLED'
  GROUP BY event_id) b ON b.event_id = e.id""", _TRANSITIONS)
def c3(spark, sf):
    f = fx(spark, sf)
    ev = f.events.select("id", "capacity", F.floor(F.col("capacity") / 2).cast("int").alias("remaining"))
    return C.release_cancelled(ev, status_transitions(f.commands))


@register("C4_create_events", """SELECT id, name, capacity, remaining, ticket_price_cents FROM v_events_stocked
UNION ALL SELECT id, name, capacity, capacity, ticket_price_cents FROM v_new_events
WHERE COALESCE(name, '') <> '' AND COALESCE(capacity, 0) <> 0 AND capacity >= 1
  AND COALESCE(ticket_price_cents, 0) <> 0 AND ticket_price_cents >= 0""")
def c4(spark, sf):
    f = fx(spark, sf)
    table, _ = C.create_events(f.events_stocked, f.new_events)
    return table.select("id", "name", "capacity", "remaining", "ticket_price_cents")


@register("C5_patch_events", """SELECT e.id, COALESCE(p.name, e.name) AS name, COALESCE(p.capacity, e.capacity) AS capacity,
  e.remaining, COALESCE(p.ticket_price_cents, e.ticket_price_cents) AS ticket_price_cents
FROM v_events_stocked e LEFT JOIN v_event_patches p ON p.id = e.id
  AND COALESCE(p.capacity, 0) >= 0 AND COALESCE(p.ticket_price_cents, 0) >= 0""")
def c5(spark, sf):
    f = fx(spark, sf)
    return C.patch_events(f.events_stocked, f.event_patches).select(
        "id", "name", "capacity", "remaining", "ticket_price_cents")


@register("C5_patch_outcomes", """SELECT p.id, CASE WHEN COALESCE(p.capacity, 0) < 0
    OR COALESCE(p.ticket_price_cents, 0) < 0 THEN 'invalid'
  WHEN e.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome
FROM v_event_patches p LEFT JOIN v_events_stocked e ON p.id = e.id""")
def c5o(spark, sf):
    f = fx(spark, sf)
    return C.patch_outcomes(f.events_stocked, f.event_patches).select("id", "outcome")


@register("C6_delete_events", """SELECT id, name FROM v_events WHERE id NOT IN (
  SELECT id FROM v_event_patches WHERE id NOT IN (SELECT event_id FROM v_bookings))""")
def c6(spark, sf):
    f = fx(spark, sf)
    kept, _ = C.delete_events(f.events, f.event_patches.select("id"), f.bookings)
    return kept.select("id", "name")


@register("C6_blocked", "SELECT DISTINCT id FROM v_event_patches WHERE id IN (SELECT event_id FROM v_bookings)")
def c6b(spark, sf):
    f = fx(spark, sf)
    _, blocked = C.delete_events(f.events, f.event_patches.select("id"), f.bookings)
    return blocked


_EMAIL_OK = r"regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"


@register("C7_register_users", """SELECT v.request_id, v.email,
  CASE WHEN NOT v.valid THEN 'invalid'
       WHEN v.email IN (SELECT email FROM v_users) OR v.seq <> fr.f THEN 'conflict' ELSE 'created' END AS outcome
FROM v LEFT JOIN fr ON fr.email = v.email""", {
    "v": f"""SELECT *, CAST(request_id AS BIGINT) AS seq,
  COALESCE(email, '') <> '' AND {_EMAIL_OK} AND COALESCE(password_length, 0) <> 0
  AND password_length BETWEEN 8 AND 64 AS valid FROM v_registrations""",
    "fr": "SELECT email, MIN(seq) AS f FROM v WHERE valid GROUP BY email"})
def c7(spark, sf):
    f = fx(spark, sf)
    new = f.registrations.withColumn("seq", F.col("request_id").cast("bigint"))
    return C.register_users(f.users, new, "seq").select("request_id", "email", "outcome")


_PROFILE_OUT = {"o": """SELECT target_id, caller_id, full_name,
  CASE WHEN COALESCE(caller_id, '') = '' OR caller_id <> target_id THEN 'forbidden'
       WHEN COALESCE(full_name, '') <> '' AND (length(full_name) < 2 OR length(full_name) > 100) THEN 'invalid'
       WHEN target_id NOT IN (SELECT id FROM v_users) THEN 'not_found' ELSE 'updated' END AS outcome
FROM v_profile_patches"""}


@register("C8_patch_profiles", """SELECT u.id, u.email, u.role,
  CASE WHEN o.outcome = 'updated' THEN o.full_name ELSE u.full_name END AS full_name
FROM v_users u LEFT JOIN (SELECT * FROM o WHERE outcome = 'updated') o ON o.target_id = u.id""", _PROFILE_OUT)
def c8(spark, sf):
    f = fx(spark, sf)
    users, _ = C.patch_profiles(f.users, f.profile_patches)
    return users


@register("C8_patch_outcomes", "SELECT * FROM o", _PROFILE_OUT)
def c8o(spark, sf):
    f = fx(spark, sf)
    _, res = C.patch_profiles(f.users, f.profile_patches)
    return res
