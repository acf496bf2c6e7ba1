"""Lookups, projections, filters and ordered listing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatflow.functions.columns import cents_to_currency
from seatflow.schemas import (CONFIRMED, DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE, PENDING)


SEEK_ROWS = 10_000  # that a page may skip in its top-k
SEEK_BUCKETS = 1024


def ts_literal(df: DataFrame, column: str, text: str) -> Column:
    """ISO text as a timestamp of the same kind as ``df[column]``.

    Matching the column's type keeps the comparison free of casts on the
    column, so the filter reaches the Parquet scan.
    """
    lit = F.to_timestamp(F.lit(text))
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return lit.cast("timestamp_ntz")
    return lit


def _ids(ids: DataFrame, key: str, ids_key: str | None) -> DataFrame:
    return ids.select(F.col(ids_key or ids.columns[0]).alias(key))


def lookup(df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the id set (left-semi join).

    The join is left to the planner: a small id set is broadcast by AQE from
    its measured size, a large one is shuffled.
    """
    return df.join(_ids(ids, key, ids_key), key, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str | None = None) -> DataFrame:
    """P1, not-found side: requested ids with no row in ``df``."""
    return _ids(ids, key, ids_key).distinct().join(df.select(key), key, "left_anti")


def lookup_by_email(users: DataFrame, emails: DataFrame, email_col: str = "email") -> DataFrame:
    """Exact, case-sensitive e-mail match."""
    return users.join(_ids(emails, "email", email_col), "email", "left_semi")


def event_cards(events: DataFrame) -> DataFrame:
    """The public event shape: start as date_time, capacity as total_tickets,
    price in currency units; ends_at is not shown."""
    return events.select(
        "id", "name", "description",
        F.col("starts_at").alias("date_time"),
        F.col("capacity").alias("total_tickets"),
        cents_to_currency("ticket_price_cents").alias("ticket_price"),
        "remaining")


def booking_cards(bookings: DataFrame) -> DataFrame:
    """The documented five-field booking shape."""
    return bookings.select("id", "event_id", "user_id", "quantity", "status")


def confirmed_by_event(bookings: DataFrame, event_ids: DataFrame, ids_key: str | None = None) -> DataFrame:
    """P5: CONFIRMED bookings of the given events (status filter reaches the scan)."""
    return (bookings.where(F.col("status") == CONFIRMED)
            .join(_ids(event_ids, "event_id", ids_key), "event_id", "left_semi"))


def pending_older_than(bookings: DataFrame, cutoff: str) -> DataFrame:
    """PENDING bookings created strictly before ``cutoff`` (ISO text)."""
    return bookings.where((F.col("status") == PENDING)
                          & (F.col("created_at") < ts_literal(bookings, "created_at", cutoff)))


def split_by_start(events: DataFrame, as_of: str) -> DataFrame:
    """``phase`` = upcoming when starts_at > as_of, else past.  The clock is
    an argument, never the current time."""
    t = ts_literal(events, "starts_at", as_of)
    return events.withColumn("phase", F.when(F.col("starts_at") > t, F.lit("upcoming")).otherwise(F.lit("past")))


def filter_by_role(df: DataFrame, roles, role_col: str = "role") -> DataFrame:
    """``allowed`` when the role is in the set; ``reason`` tells a missing
    role (NO_ROLE) from a role outside the set (FORBIDDEN)."""
    r = F.col(role_col)
    reason = (F.when(r.isNull() | (r == ""), F.lit("NO_ROLE"))
               .when(~r.isin(list(roles)), F.lit("FORBIDDEN")))
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def filter_own_rows(patches: DataFrame, caller: str = "caller_id", target: str = "target_id") -> DataFrame:
    """A caller may change only its own row; no caller is refused too."""
    c, t = F.col(caller), F.col(target)
    reason = (F.when(c.isNull() | (c == ""), F.lit("UNAUTHORIZED"))
               .when(c != t, F.lit("FORBIDDEN")))
    return patches.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def list_events(events: DataFrame) -> DataFrame:
    """O1: by start time; id breaks ties so the order is total."""
    return events.orderBy("starts_at", "id")


def normalise_page(limit, offset) -> tuple[int, int]:
    """Page arguments as the listing endpoint reads them: unreadable or
    non-positive limit -> 20, above 100 -> 100, negative offset -> 0."""
    def as_int(v):
        # ASCII digits with an optional sign, nothing else
        return int(str(v)) if re.fullmatch(r"[+-]?[0-9]+", str(v)) else None

    n, k = as_int(limit), as_int(offset)
    if n is None or n <= 0:
        n = DEFAULT_PAGE_SIZE
    n = min(n, MAX_PAGE_SIZE)
    if k is None or k < 0:
        k = 0
    return n, k


def _bucket_of(rows: DataFrame, bucket: Column, skip: int):
    """The bucket (in order, nulls first) that holds the row after ``skip``
    others: one row with ``b``, its rows ``n`` and those ``before`` it."""
    counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket is ordered here, never events
    counts = counts.withColumn("before", F.sum("n").over(Window.orderBy("b")) - F.col("n"))
    return counts.where((F.col("before") <= skip) & (F.col("before") + F.col("n") > skip)).first()


def seek(events: DataFrame, offset: int, most: int = SEEK_ROWS) -> tuple[DataFrame, int]:
    """The rows of O1's order from some point before row ``offset`` on, and how
    many of them to skip: ``most`` at most, unless more rows than that agree in
    start time and id.

    The point is found by histograms: of the start times, in ever narrower
    buckets, then, where many events start at one instant, of their ids two
    characters at a time.  Each is one grouped count over the rows still in
    question, a filter the scan can use.
    """
    ts, id_ = F.col("starts_at"), F.col("id").cast("string")
    kind = events.schema["starts_at"].dataType
    us = F.unix_micros(ts.cast("timestamp"))
    total, undated, lo, hi = events.agg(F.count(F.lit(1)), F.count_if(ts.isNull()), F.min(us), F.max(us)).first()
    if offset >= total:
        return events.where(F.lit(False)), 0

    def moment(v: int) -> Column:
        return F.timestamp_micros(F.lit(v)).cast(kind)

    if offset < undated:
        inside, after, skip, n = ts.isNull(), ts.isNotNull(), offset, undated
    else:
        skip, n = offset - undated, total - undated
        while n > most and lo < hi:
            width = -(-(hi - lo + 1) // SEEK_BUCKETS)
            inside = (ts >= moment(lo)) & (ts <= moment(hi))
            found = _bucket_of(events.where(inside), F.floor((us - F.lit(lo)) / F.lit(width)), skip)
            lo, n, skip = lo + int(found["b"]) * width, found["n"], skip - found["before"]
            hi = min(hi, lo + width - 1)
        inside, after = (ts >= moment(lo)) & (ts <= moment(hi)), ts > moment(hi)
    prefix = ""
    while n > most:  # one instant (or none): by id
        at = len(prefix)
        found = _bucket_of(events.where(inside & (id_.startswith(prefix) if prefix else F.lit(True))),
                           F.substring(id_, at + 1, 2), skip)
        skip, n = skip - found["before"], found["n"]
        if not found["b"]:  # no id, or ids that end here: equal ones
            prefix = None if found["b"] is None else prefix
            break
        prefix += found["b"]
    here = inside if not prefix else inside & (id_ >= F.lit(prefix))
    return events.where(here | after), skip


def page_events(events: DataFrame, limit=DEFAULT_PAGE_SIZE, offset=0) -> DataFrame:
    """O2: one page of O1.  The first page is a top-k.  Behind an offset,
    histograms find a point shortly before the page (``seek``), and the page is
    a top-k from there: no task and no driver holds or orders the rows before
    it, be they all on one day or at one instant."""
    n, k = normalise_page(limit, offset)
    if not k:
        return list_events(events).limit(n)
    rest, skip = seek(events, k)
    return list_events(rest).offset(skip).limit(n)


def page_events_after(events: DataFrame, after_starts_at: str | None, after_id: str | None,
                      limit=DEFAULT_PAGE_SIZE) -> DataFrame:
    """O2, keyset form: the page after (starts_at, id); cost does not grow
    with the page number."""
    n, _ = normalise_page(limit, 0)
    if after_starts_at is not None:
        t = ts_literal(events, "starts_at", after_starts_at)
        s = F.col("starts_at")
        events = events.where((s > t) | ((s == t) & (F.col("id") > F.lit(after_id))))
    return list_events(events).limit(n)
