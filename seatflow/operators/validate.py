"""Row checks (P8-P12).  Each adds one ``errors`` array column in a single
pass; ``split_valid`` separates good rows from bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.columns import error_list
from seatflow.schemas import (EMAIL_PATTERN, MAX_FULL_NAME, MAX_PASSWORD, MAX_QUANTITY, MIN_FULL_NAME,
                              MIN_PASSWORD, MIN_QUANTITY, UUID4_PATTERN)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _missing_int(c: Column) -> Column:
    # a required integer refuses its zero value as well as an absent one
    return c.isNull() | (c == 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``errors``, bad rows with it)."""
    ok = F.size("errors") == 0
    return checked.where(ok).drop("errors"), checked.where(~ok)


def validate_bookings(requests: DataFrame, id_format: str | None = "uuid4") -> DataFrame:
    """event_id required (and a v4 uuid unless ``id_format`` is None),
    quantity required and within 1..10, user_id not empty.  One error per
    field: the first rule that fails."""
    ev, q, u = F.col("event_id"), F.col("quantity"), F.col("user_id")
    checks = [(_blank(ev), "event_id:required")]
    if id_format == "uuid4":
        checks.append((~_blank(ev) & ~ev.rlike(UUID4_PATTERN), "event_id:uuid4"))
    checks += [
        (_missing_int(q), "quantity:required"),
        (~_missing_int(q) & (q < MIN_QUANTITY), "quantity:min"),
        (~_missing_int(q) & (q > MAX_QUANTITY), "quantity:max"),
        (_blank(u), "user_id:required"),
    ]
    return requests.withColumn("errors", error_list(*checks))


def validate_new_events(rows: DataFrame, allow_free: bool = False) -> DataFrame:
    """Name required; capacity required and >= 1; price required and
    >= 0.  As coded, a required price refuses 0, so a free event cannot be
    created; ``allow_free`` accepts it."""
    name, cap, price = F.col("name"), F.col("capacity"), F.col("ticket_price_cents")
    price_missing = price.isNull() if allow_free else _missing_int(price)
    return rows.withColumn("errors", error_list(
        (_blank(name), "name:required"),
        (_missing_int(cap), "capacity:required"),
        (~_missing_int(cap) & (cap < 1), "capacity:min"),
        (price_missing, "ticket_price_cents:required"),
        (~price_missing & (price < 0), "ticket_price_cents:min"),
    ))


def validate_event_patches(rows: DataFrame) -> DataFrame:
    """P10: capacity >= 0 and price >= 0 when given; absent means keep."""
    cap, price = F.col("capacity"), F.col("ticket_price_cents")
    return rows.withColumn("errors", error_list(
        (cap.isNotNull() & (cap < 0), "capacity:gte"),
        (price.isNotNull() & (price < 0), "ticket_price_cents:gte"),
    ))


def validate_messages(parsed: DataFrame) -> DataFrame:
    """An unreadable body is refused; otherwise booking_id, user_id and
    event_id must be non-empty and quantity positive."""
    q = F.col("quantity")
    return parsed.withColumn("errors", F.when(
        ~F.col("parsed"), F.array(F.lit("body:invalid_json"))
    ).otherwise(error_list(
        (_blank(F.col("booking_id")), "booking_id:required"),
        (_blank(F.col("user_id")), "user_id:required"),
        (_blank(F.col("event_id")), "event_id:required"),
        (q.isNull() | (q <= 0), "quantity:positive"),
    )))


def validate_registrations(rows: DataFrame) -> DataFrame:
    """E-mail required and of e-mail form; password 8..64 characters.
    Rows carry ``password_length`` (or ``password``, measured here)."""
    email = F.col("email")
    n = F.col("password_length") if "password_length" in rows.columns else F.length("password")
    return rows.withColumn("errors", error_list(
        (_blank(email), "email:required"),
        (~_blank(email) & ~email.rlike(EMAIL_PATTERN), "email:email"),
        (_missing_int(n), "password:required"),
        (~_missing_int(n) & (n < MIN_PASSWORD), "password:min"),
        (~_missing_int(n) & (n > MAX_PASSWORD), "password:max"),
    ))


def validate_profiles(rows: DataFrame) -> DataFrame:
    """full_name may be absent; when given it has 2..100 characters."""
    name = F.col("full_name")
    given = name.isNotNull() & (name != "")
    return rows.withColumn("errors", error_list(
        (given & (F.length(name) < MIN_FULL_NAME), "full_name:min"),
        (given & (F.length(name) > MAX_FULL_NAME), "full_name:max"),
    ))
