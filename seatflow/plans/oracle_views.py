"""The fixture views as DuckDB text, inlined as CTEs into oracle queries.

The driver registers only the base tables, so every oracle query carries the
views it needs.  Same rules as ``seatflow.plans.fixtures`` (FIXTURES.md §4).
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_users": """SELECT
  CAST(c_custkey AS VARCHAR) AS id,
  'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
  CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'USER' END AS role,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS full_name
FROM customer""",
    "v_events": """SELECT
  CAST(p_partkey AS VARCHAR) AS id,
  p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS description,
  TIMESTAMP '1998-01-01 00:00:00' + to_minutes(CAST(p_partkey * 1013 % 1576800 AS INTEGER)) AS starts_at,
  TIMESTAMP '1998-01-01 02:00:00' + to_minutes(CAST(p_partkey * 1013 % 1576800 AS INTEGER)) AS ends_at,
  CAST(p_size AS INTEGER) AS capacity,
  CAST(round(p_retailprice * 100) AS BIGINT) AS ticket_price_cents
FROM part""",
    "v_prices": """SELECT id AS event_id, TIMESTAMP '1900-01-01 00:00:00' AS valid_from, ticket_price_cents FROM v_events
  UNION ALL
  SELECT id, TIMESTAMP '1998-07-01 00:00:00', ticket_price_cents + 100 * (CAST(id AS BIGINT) % 7) FROM v_events""",
    "v_requests": """SELECT
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-'
    || CAST(l_suppkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m%d') AS id,
  CAST(o_custkey AS VARCHAR) AS user_id,
  CAST(l_partkey AS VARCHAR) AS event_id,
  CAST(l_quantity AS INTEGER) AS quantity,
  o_orderdate + to_minutes(CAST((l_orderkey * 7 + l_linenumber * 131 + l_suppkey * 17) % 1440 AS INTEGER)) AS created_at,
  CAST(l_suppkey % 30 + 1 AS INTEGER) AS delay_minutes,
  o_orderstatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_bookings": """SELECT
  r.id, r.user_id, r.event_id, r.quantity, e.ticket_price_cents AS unit_price_cents,
  CASE r.o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'P' THEN 'CANCELLED' ELSE 'PENDING' END AS status,
  r.created_at,
  CASE WHEN r.o_orderstatus = 'O' THEN r.created_at
       ELSE r.created_at + to_minutes(r.delay_minutes) END AS updated_at
FROM v_requests r JOIN v_events e ON r.event_id = e.id
WHERE r.quantity BETWEEN 1 AND 10""",
    "v_commands": """SELECT id AS booking_id, event_id, quantity, created_at AS ts, 0 AS seq, 'CREATE' AS command FROM v_bookings
  UNION ALL
  SELECT id, event_id, quantity, updated_at, 1, CASE status WHEN 'CONFIRMED' THEN 'CONFIRM' ELSE 'CANCEL' END
  FROM v_bookings WHERE status <> 'PENDING'
  UNION ALL
  SELECT id, event_id, quantity, updated_at + to_minutes(1), 2, CASE status WHEN 'CONFIRMED' THEN 'CONFIRM' ELSE 'CANCEL' END
  FROM v_bookings WHERE status <> 'PENDING' AND CAST(user_id AS BIGINT) % 5 = 0
  UNION ALL
  SELECT id, event_id, quantity, updated_at + to_minutes(2), 3, CASE status WHEN 'CONFIRMED' THEN 'CANCEL' ELSE 'CONFIRM' END
  FROM v_bookings WHERE status <> 'PENDING' AND CAST(user_id AS BIGINT) % 13 = 0""",
    "v_messages": """SELECT
  event_id AS offset_id, ts,
  CASE WHEN event_id % 97 = 0 THEN 'invalid json'
       ELSE '{"booking_id":"' || CAST(event_id AS VARCHAR) || '","user_id":"' || CAST(user_id AS VARCHAR)
            || '","event_id":"' || CAST(event_id % 20 AS VARCHAR) || '","quantity":' || CAST(event_id % 12 AS VARCHAR) || '}'
  END AS body
FROM events""",
    "v_access": """SELECT
  CAST(event_id AS VARCHAR) AS request_id, ts,
  CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'POST' ELSE 'GET' END AS method,
  CASE event_type WHEN 'purchase' THEN '/api/v1/bookings' WHEN 'signup' THEN '/api/v1/users/register'
                  WHEN 'view' THEN '/api/v1/events' ELSE '/api/v1/events/:id' END AS path,
  CAST(CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 404
            WHEN event_id % 19 = 0 THEN 409 ELSE 200 END AS INTEGER) AS status,
  value AS latency_ms,
  '10.0.0.' || CAST(user_id AS VARCHAR) AS client_ip,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id
FROM events""",
    "v_booking_messages": """SELECT created_at AS ts, 0 AS copy,
    CASE WHEN CAST(user_id AS BIGINT) % 97 = 3 THEN 'invalid json'
         ELSE '{"booking_id":"' || id || '","user_id":"' || user_id || '","event_id":"' || event_id
              || '","quantity":' || CAST(quantity AS VARCHAR) || '}' END AS body
  FROM v_bookings WHERE CAST(user_id AS BIGINT) % 7 <> 0
  UNION ALL
  SELECT created_at + to_minutes(1), 1,
    '{"booking_id":"' || id || '","user_id":"' || user_id || '","event_id":"' || event_id
      || '","quantity":' || CAST(quantity AS VARCHAR) || '}'
  FROM v_bookings WHERE CAST(user_id AS BIGINT) % 5 = 1""",
    "v_uuid_requests": """SELECT id, user_id, quantity,
  substr(md5(event_id), 1, 8) || '-' || substr(md5(event_id), 9, 4) || '-'
    || CASE WHEN CAST(event_id AS BIGINT) % 31 = 0 THEN '1' ELSE '4' END || substr(md5(event_id), 14, 3) || '-a'
    || substr(md5(event_id), 18, 3) || '-' || substr(md5(event_id), 21, 12) AS event_id
FROM v_requests""",
    "v_orphan_bookings": """SELECT id,
  CASE WHEN CAST(user_id AS BIGINT) % 97 = 0 THEN 'x' || user_id ELSE user_id END AS user_id,
  CASE WHEN CAST(event_id AS BIGINT) % 89 = 0 THEN 'x' || event_id ELSE event_id END AS event_id, quantity, status
FROM v_bookings""",
    "v_counters": """SELECT 'event:remaining:' || id AS key, capacity - CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN 1 ELSE 0 END AS remaining
  FROM v_events WHERE CAST(id AS BIGINT) % 10 <> 3
  UNION ALL SELECT 'event:remaining:x1', 5
  UNION ALL SELECT 'booking:pending:x2', 1""",
    "v_event_patches": """SELECT id,
  CASE WHEN CAST(id AS BIGINT) % 8 = 0 THEN name || ' (new)' END AS name,
  CASE CAST(id AS BIGINT) % 12 WHEN 0 THEN CAST(floor(capacity / 2) AS INTEGER) WHEN 4 THEN capacity * 2 END AS capacity,
  CASE WHEN CAST(id AS BIGINT) % 16 = 0 THEN ticket_price_cents + 500 END AS ticket_price_cents
FROM v_events WHERE CAST(id AS BIGINT) % 4 = 0""",
    "v_profile_patches": """SELECT id AS target_id,
  CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN id || '0' ELSE id END AS caller_id,
  CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN NULL WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'A' ELSE 'Name ' || id END AS full_name
FROM v_users WHERE CAST(id AS BIGINT) % 3 = 0""",
    "v_registrations": """SELECT CAST(s_suppkey AS VARCHAR) AS request_id,
  CASE WHEN s_suppkey % 10 = 0 THEN 'no-at-sign' WHEN s_suppkey % 4 = 0 THEN 'user' || CAST(s_suppkey AS VARCHAR) || '@example.com'
       ELSE 'new' || CAST(s_suppkey % 40 AS VARCHAR) || '@example.com' END AS email,
  CAST(4 + s_suppkey % 64 AS INTEGER) AS password_length
FROM supplier""",
}

VIEWS["v_new_events"] = """SELECT 'new-' || CAST(p_partkey AS VARCHAR) AS id,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS description,
  TIMESTAMP '1998-01-01 00:00:00' + to_minutes(CAST(p_partkey * 1013 % 1576800 AS INTEGER)) AS starts_at,
  TIMESTAMP '1998-01-01 02:00:00' + to_minutes(CAST(p_partkey * 1013 % 1576800 AS INTEGER)) AS ends_at,
  CAST(p_size - 5 AS INTEGER) AS capacity,
  CASE WHEN p_partkey % 7 = 0 THEN CAST(0 AS BIGINT) WHEN p_partkey % 11 = 0 THEN CAST(NULL AS BIGINT)
       ELSE CAST(round(p_retailprice * 100) AS BIGINT) END AS ticket_price_cents
FROM part"""
# derived views used by several oracle queries
VIEWS["v_events_stocked"] = "SELECT *, capacity AS remaining FROM v_events"


def _deps(name: str) -> list[str]:
    body = VIEWS[name]
    return [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", body)]


def with_views(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs it (transitively) mentions, in order.

    ``extra`` adds query-local CTEs (name -> text) that may use the views; they
    are placed after the views, in the given order.
    """
    extra = extra or {}
    text = body + " " + " ".join(extra.values())
    wanted = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        for d in _deps(v):
            visit(d)
        order.append(v)

    for v in wanted:
        visit(v)
    ctes = [f"{v} AS (\n{VIEWS[v]}\n)" for v in order]
    ctes += [f"{k} AS (\n{t}\n)" for k, t in extra.items()]
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body
