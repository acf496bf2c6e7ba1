"""Aggregations (A1-A11).  Every one is a single grouped pass with partial
(map-side) aggregation before the shuffle; money stays in whole cents and
becomes currency only in the last projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatflow.functions.columns import cents_to_currency
from seatflow.operators.select import ts_literal
from seatflow.schemas import (CANCELLED, CONFIRMED, GAUGE_REVENUE, GAUGE_TICKETS, KEY_REMAINING_PREFIX,
                              PENDING, ROLE_ADMIN, ROLE_USER, STATUSES)


def confirmed_totals(bookings: DataFrame) -> DataFrame:
    """Seats and revenue cents of CONFIRMED bookings per event, in one pass.
    The status filter is pushed to the scan."""
    return (bookings.where(F.col("status") == CONFIRMED)
            .groupBy("event_id")
            .agg(F.sum("quantity").cast("bigint").alias("tickets_sold"),
                 F.sum(F.col("quantity").cast("bigint") * F.col("unit_price_cents")).cast("bigint")
                 .alias("revenue_cents")))


def tickets_sold(bookings: DataFrame) -> DataFrame:
    """A1: CONFIRMED seats per event."""
    return confirmed_totals(bookings).select("event_id", "tickets_sold")


def revenue_cents(bookings: DataFrame) -> DataFrame:
    """A2: sum of quantity x captured unit price over CONFIRMED bookings."""
    return confirmed_totals(bookings).select("event_id", "revenue_cents")


def event_stats(events: DataFrame, bookings: DataFrame) -> DataFrame:
    """A3: A1 and A2 for every event in one aggregate, then currency.

    Plan: scan with pushed status filter -> partial sums -> shuffle by
    event_id -> final sums -> join with the event ids -> project.
    """
    t = confirmed_totals(bookings).withColumnRenamed("event_id", "id")
    j = events.select("id").join(t, "id", "left")
    cents = F.coalesce("revenue_cents", F.lit(0)).cast("bigint")
    return j.select(F.col("id").alias("event_id"),
                    F.coalesce("tickets_sold", F.lit(0)).cast("bigint").alias("tickets_sold"),
                    cents.alias("revenue_cents"),
                    cents_to_currency(cents).alias("revenue"))


def gauge_stats(events: DataFrame, bookings: DataFrame) -> DataFrame:
    """A4: the two gauge values per event, recomputed fresh each time from
    cents (no floating sum row by row, no value frozen in a cache)."""
    s = event_stats(events, bookings)
    return s.select("event_id",
                    F.col("tickets_sold").cast("double").alias(GAUGE_TICKETS),
                    F.col("revenue").alias(GAUGE_REVENUE))


def data_summary(users: DataFrame, events: DataFrame, bookings: DataFrame, as_of: str) -> DataFrame:
    """A5: the ten seed-summary counts in one row.  The three tables are
    tagged and unioned into one global aggregate (partial counts per task),
    so no join of one-row frames is needed."""
    t = ts_literal(events, "starts_at", as_of)
    u = users.select(F.lit("u").alias("_t"), F.col("role").alias("_a"), F.lit(None).cast("boolean").alias("_up"))
    e = events.select(F.lit("e").alias("_t"), F.lit(None).cast("string").alias("_a"),
                      (F.col("starts_at") > t).alias("_up"))
    b = bookings.select(F.lit("b").alias("_t"), F.col("status").alias("_a"), F.lit(None).cast("boolean").alias("_up"))
    x = u.unionByName(e).unionByName(b)
    tt, a, up = F.col("_t"), F.col("_a"), F.col("_up")
    return x.agg(
        F.count_if(tt == "u").alias("total_users"),
        F.count_if((tt == "u") & (a == ROLE_ADMIN)).alias("admin_users"),
        F.count_if((tt == "u") & (a == ROLE_USER)).alias("regular_users"),
        F.count_if(tt == "e").alias("total_events"),
        F.count_if((tt == "e") & up).alias("upcoming_events"),
        F.count_if((tt == "e") & ~up).alias("past_events"),
        F.count_if(tt == "b").alias("total_bookings"),
        F.count_if((tt == "b") & (a == CONFIRMED)).alias("confirmed_bookings"),
        F.count_if((tt == "b") & (a == PENDING)).alias("pending_bookings"),
        F.count_if((tt == "b") & (a == CANCELLED)).alias("cancelled_bookings"),
    )


def data_summary_json(users: DataFrame, events: DataFrame, bookings: DataFrame, as_of: str) -> DataFrame:
    """A5 as one JSON object with the loader's key names."""
    s = data_summary(users, events, bookings, as_of)
    names = [("users", "total_users"), ("admin_users", "admin_users"), ("regular_users", "regular_users"),
             ("events", "total_events"), ("upcoming_events", "upcoming_events"), ("past_events", "past_events"),
             ("bookings", "total_bookings"), ("confirmed_bookings", "confirmed_bookings"),
             ("pending_bookings", "pending_bookings"), ("cancelled_bookings", "cancelled_bookings")]
    return s.select(F.to_json(F.struct(*[F.col(c).alias(k) for k, c in names])).alias("summary"))


def tracked_event_ids(keys: DataFrame, key_col: str = "key", distinct: bool = False,
                      keep_value: bool = False) -> DataFrame:
    """Event ids named by ``event:remaining:<id>`` keys.  As in a key
    scan, repeats are kept unless ``distinct``."""
    k = F.col(key_col)
    out = keys.where(k.startswith(KEY_REMAINING_PREFIX)).withColumn(
        "event_id", F.substring(k, len(KEY_REMAINING_PREFIX) + 1, 1 << 30))
    out = out if keep_value else out.select("event_id")
    return out.distinct() if distinct else out


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key values held by more than one row, with their count."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def remaining_held(events: DataFrame, bookings: DataFrame) -> DataFrame:
    """The live rule: PENDING and CONFIRMED bookings both hold seats."""
    held = (bookings.where(F.col("status").isin(PENDING, CONFIRMED))
            .groupBy("event_id").agg(F.sum("quantity").cast("bigint").alias("held"))
            .withColumnRenamed("event_id", "id"))
    return (events.select("id", "capacity").join(held, "id", "left")
            .select("id", (F.col("capacity") - F.coalesce("held", F.lit(0))).cast("int").alias("remaining")))


def severity(log: DataFrame) -> DataFrame:
    """Level of each request as the access logger picks it."""
    err = F.col("errors") if "errors" in log.columns else F.lit(None).cast("string")
    st = F.col("status")
    level = (F.when(err.isNotNull() & (err != ""), F.lit("error"))
              .when(st >= 500, F.lit("error"))
              .when(st >= 400, F.lit("warn"))
              .otherwise(F.lit("info")))
    return log.withColumn("level", level)


def access_severity(log: DataFrame) -> DataFrame:
    """A10: requests per (path, level) with mean and median latency.  Rows are
    counted per latency first, so the median is exact at any size and a
    window holds one row per distinct latency, never a group's requests."""
    each = severity(log).groupBy("path", "level", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("path", "level")
    run = group.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("latency_ms").isNotNull(), F.col("n")).otherwise(0)
    each = each.withColumns({"_run": F.sum(known).over(run), "_half": F.ceil(F.sum(known).over(group) / 2)})
    return each.groupBy("path", "level").agg(
        F.sum("n").alias("requests"),
        F.round(F.sum(F.col("latency_ms") * F.col("n")) / F.sum(known), 6).alias("avg_latency_ms"),
        F.min(F.when(F.col("_run") >= F.col("_half"), F.col("latency_ms"))).alias("p50_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"))


def status_counts(bookings: DataFrame) -> DataFrame:
    """Bookings per status for every event with bookings.  The pivot
    values are fixed, so no extra job looks them up."""
    p = bookings.groupBy("event_id").pivot("status", list(STATUSES)).agg(F.count(F.lit(1)))
    return p.select("event_id", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s.lower())
                                  for s in STATUSES])
