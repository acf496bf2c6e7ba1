"""Fixed schemas, status names and limits of the reservation data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must equal the service's for equal results) -------------
# booking status names, role names, message routing key, key prefixes
PENDING, CONFIRMED, CANCELLED = "PENDING", "CONFIRMED", "CANCELLED"
STATUSES = (PENDING, CONFIRMED, CANCELLED)
ROLE_USER, ROLE_ADMIN = "USER", "ADMIN"
ROLES = (ROLE_USER, ROLE_ADMIN)
ROUTING_KEY_CREATED = "booking.created"
KEY_REMAINING_PREFIX = "event:remaining:"
KEY_REVENUE_PREFIX = "event:revenue:"
KEY_PENDING_PREFIX = "booking:pending:"
GAUGE_TICKETS = "tickets_sold_total"
GAUGE_REVENUE = "revenue_total"
# request limits: quantity 1..10 per booking; password 8..64; full name 2..100;
# page size default 20, at most 100; pending bookings live 15 minutes
MIN_QUANTITY, MAX_QUANTITY = 1, 10
MIN_PASSWORD, MAX_PASSWORD = 8, 64
MIN_FULL_NAME, MAX_FULL_NAME = 2, 100
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
PENDING_TTL_MINUTES = 15
# rate plans: (rate per second, burst); anonymous per client IP, signed-in per user
PLAN_ANON = (2.0, 5)
PLAN_USER = (10.0, 20)
# uuid version 4, lower case (the request validator's form)
UUID4_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# ---------------------------------------------------------------------------


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


USERS = T.StructType([
    _f("id", T.StringType(), False),
    _f("email", T.StringType(), False),
    _f("role", T.StringType(), False),
    _f("full_name", T.StringType()),
    _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

EVENTS = T.StructType([
    _f("id", T.StringType(), False),
    _f("name", T.StringType(), False),
    _f("description", T.StringType()),
    _f("starts_at", T.TimestampType(), False),
    _f("ends_at", T.TimestampType(), False),
    _f("capacity", T.IntegerType(), False),
    _f("remaining", T.IntegerType(), False),
    _f("ticket_price_cents", T.LongType(), False),
    _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

BOOKINGS = T.StructType([
    _f("id", T.StringType(), False),
    _f("user_id", T.StringType(), False),
    _f("event_id", T.StringType(), False),
    _f("quantity", T.IntegerType(), False),
    _f("unit_price_cents", T.LongType(), False),
    _f("status", T.StringType(), False),
    _f("created_at", T.TimestampType(), False),
    _f("updated_at", T.TimestampType(), False),
])

BOOKING_MESSAGE = T.StructType([
    _f("booking_id", T.StringType()),
    _f("user_id", T.StringType()),
    _f("event_id", T.StringType()),
    _f("quantity", T.IntegerType()),
])

# one access-log line as the request logger writes it: ISO-8601 ``ts``
# (milliseconds, zone suffix), ``latency`` in milliseconds; ``user_id`` and
# ``errors`` appear only on some lines
ACCESS_LINE = T.StructType([
    _f("level", T.StringType()),
    _f("ts", T.StringType()),
    _f("msg", T.StringType()),
    _f("log_type", T.StringType()),
    _f("request_id", T.StringType()),
    _f("method", T.StringType()),
    _f("path", T.StringType()),
    _f("status", T.IntegerType()),
    _f("latency", T.DoubleType()),
    _f("client_ip", T.StringType()),
    _f("user_agent", T.StringType()),
    _f("user_id", T.StringType()),
    _f("errors", T.StringType()),
])

GAUGE = T.StructType([
    _f("metric", T.StringType(), False),
    _f("event_id", T.StringType(), False),
    _f("value", T.DoubleType(), False),
    _f("ts", T.TimestampType(), False),
])

# column defaults the store fills when a row leaves them out
DEFAULTS = {
    "users": {"role": ROLE_USER},
    "events": {"ticket_price_cents": 0},
    "bookings": {"status": PENDING},
}

TABLES = {"users": USERS, "events": EVENTS, "bookings": BOOKINGS}

# primary and unique keys, not-null columns and foreign keys, carried as checks
KEYS = {"users": [["id"], ["email"]], "events": [["id"]], "bookings": [["id"]]}
FOREIGN_KEYS = {"bookings": [("user_id", "users", "id"), ("event_id", "events", "id")]}
