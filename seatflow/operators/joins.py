"""Equality joins of the reservation model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatflow.functions.columns import cents_to_currency
from seatflow.operators.stats import confirmed_totals, tracked_event_ids
from seatflow.schemas import KEY_REMAINING_PREFIX
from seatflow.session import ranged


def capture_price(requests: DataFrame, prices: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """The event's price valid at the request time (an as-of join).

    Requests and prices are put into one order by (event, time) and cut into
    ranges; inside an (event, range) the last price before a request is a
    window, and the price in force at a range's start is carried over from the
    ranges before.  So a request never meets an event's other prices, and a
    hot event is spread over ranges.  Later price changes do not alter a
    captured price.  A request with no price in force (no event or time, or
    before the first price) gets NULL; of prices that start at one instant
    the highest counts.
    """
    # the event and the time go along once, as the key and the order
    rest = [c for c in requests.columns if c not in ("event_id", ts_col)]
    row = F.struct(*rest, F.lit(1).alias("_kept"))
    when = dict(requests.dtypes)[ts_col]
    asks = requests.select(F.col("event_id").alias("_key"), F.col(ts_col).alias("_ts"), F.lit(1).alias("_kind"),
                           F.xxhash64(*requests.columns).alias("_tie"), row.alias("_row"))
    # a struct, so that a price that is NULL still ends the one before it
    sets = prices.where(F.col("event_id").isNotNull() & F.col("valid_from").isNotNull()).select(
        F.col("event_id").alias("_key"), F.col("valid_from").cast(when).alias("_ts"), F.lit(0).alias("_kind"),
        F.col("ticket_price_cents").cast("bigint").alias("_tie"),
        F.struct(F.col("ticket_price_cents").alias("cents")).alias("_price"))
    order = ["_ts", "_kind", "_tie"]
    # equal requests are told apart to be dealt over ranges, after that only prices are
    both = ranged(asks.unionByName(sets, allowMissingColumns=True), ["_key", *order], "price-order",
                  keep={"_tie": F.when(F.col("_kind") == 0, F.col("_tie"))})
    inside = Window.partitionBy("_key", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_okey").orderBy("_orange").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(F.col("_key").alias("_okey"), F.col("_range").alias("_orange")).agg(
        F.max_by("_price", F.when(F.col("_kind") == 0, F.struct(*order))).alias("_last")).select(
        "_okey", "_orange", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    here = both.withColumn("_here", F.last("_price", ignorenulls=True).over(inside)).where("_kind = 1")
    out = here.join(carried, F.col("_key").eqNullSafe(F.col("_okey")) & (F.col("_range") == F.col("_orange")))
    price = F.when(F.col("_ts").isNotNull(), F.coalesce("_here", "_carried"))
    back = {"event_id": F.col("_key"), ts_col: F.col("_ts")}
    return out.select(*[back.get(c, F.col("_row")[c]).alias(c) for c in requests.columns],
                      price["cents"].alias("unit_price_cents"))


def resolve_natural_keys(rows: DataFrame, users: DataFrame, events: DataFrame,
                         email_col: str = "email", name_col: str = "event_name") -> DataFrame:
    """E-mail -> user id and event name -> event id.  No match gives NULL;
    a name or e-mail held by more than one row is an error, as a scalar
    subquery returning two rows would be."""
    return event_id_by_name(user_id_by_email(rows, users, email_col), events, name_col)


def _unique(table: DataFrame, key: str, key_as: str, id_as: str) -> DataFrame:
    """(key, id) of a table, one row per key; a key held twice is an error
    when the plan runs, not a multiplied row."""
    held = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(key_as)).agg(
        F.first("id").alias(id_as), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key_as).cast("string")))
    return held.select(key_as, F.when(F.col("_n") > 1, twice.cast(table.schema["id"].dataType)).otherwise(
        F.col(id_as)).alias(id_as))


def _looked_up(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` with the id of their key.  The keys of a partition are hashed and the
    rows stream past them: sorting the rows, as the planner would, takes memory by
    the rows of a partition, where the keys are few and short."""
    return rows.join(keys.hint("shuffle_hash"), on, "left")


def user_id_by_email(rows: DataFrame, users: DataFrame, email_col: str = "email") -> DataFrame:
    """The user id of every row's e-mail (NULL when none), as a join
    rather than a lookup per row.  An e-mail held twice is an error."""
    return _looked_up(rows, _unique(users, "email", email_col, "user_id"), email_col)


def event_id_by_name(rows: DataFrame, events: DataFrame, name_col: str = "event_name") -> DataFrame:
    """The event id of every row's event name (NULL when none).  A
    name held twice is an error."""
    return _looked_up(rows, _unique(events, "name", name_col, "event_id"), name_col)


def remaining_confirmed(events: DataFrame, bookings: DataFrame) -> DataFrame:
    """Capacity minus CONFIRMED seats for every event (0 when none)."""
    sold = confirmed_totals(bookings).select(F.col("event_id").alias("id"), "tickets_sold")
    return (events.select("id", "capacity").join(sold, "id", "left")
            .select("id", (F.col("capacity") - F.coalesce("tickets_sold", F.lit(0))).cast("int")
                    .alias("remaining")))


def orphan_bookings(bookings: DataFrame, users: DataFrame, events: DataFrame) -> DataFrame:
    """Bookings whose user or event does not exist, one row per broken
    reference with its ``reason``.  The bookings are read once: two left
    joins mark what is missing, and the marks become rows."""
    users = users.select(F.col("id").alias("_user")).distinct()
    events = events.select(F.col("id").alias("_event")).distinct()
    marked = bookings.join(users, F.col("user_id") == F.col("_user"), "left").join(
        events, F.col("event_id") == F.col("_event"), "left")
    missing = F.array_compact(F.array(F.when(F.col("_user").isNull(), F.lit("MISSING_USER")),
                                      F.when(F.col("_event").isNull(), F.lit("MISSING_EVENT"))))
    broken = marked.where(F.col("_user").isNull() | F.col("_event").isNull())
    return broken.select(*bookings.columns, F.explode(missing).alias("reason"))


def stats_existing_events(event_ids: DataFrame, events: DataFrame, bookings: DataFrame,
                          ids_key: str | None = None) -> DataFrame:
    """Statistics for the requested events that exist; an existing event
    without bookings gives zeros, an unknown id gives no row."""
    ids = event_ids.select(F.col(ids_key or event_ids.columns[0]).alias("id")).distinct()
    known = events.select("id").join(ids, "id", "left_semi")
    # only the wanted events' bookings are summed
    wanted = bookings.join(known.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    t = confirmed_totals(wanted).withColumnRenamed("event_id", "id")
    out = known.join(t, "id", "left")
    return out.select(
        F.col("id").alias("event_id"),
        F.coalesce("tickets_sold", F.lit(0)).cast("bigint").alias("tickets_sold"),
        F.coalesce("revenue_cents", F.lit(0)).cast("bigint").alias("revenue_cents"),
        cents_to_currency(F.coalesce("revenue_cents", F.lit(0))).alias("revenue"))


def inventory_drift(counters: DataFrame, events: DataFrame) -> DataFrame:
    """Counter value against the table's ``remaining``; only disagreeing
    pairs and one-sided keys are returned, with ``side`` and ``difference``."""
    c = (tracked_event_ids(counters, keep_value=True)
         .select("event_id", F.col("remaining").alias("counter_remaining")))
    t = events.select(F.col("id").alias("event_id"), F.col("remaining").alias("table_remaining"))
    j = c.join(t, "event_id", "full_outer")
    side = (F.when(F.col("counter_remaining").isNull(), F.lit("table_only"))
             .when(F.col("table_remaining").isNull(), F.lit("counter_only"))
             .otherwise(F.lit("both")))
    return (j.withColumn("side", side)
            .withColumn("difference", (F.col("counter_remaining") - F.col("table_remaining")).cast("int"))
            .where((F.col("side") != "both") | (F.col("difference") != 0)))


def unpublished_bookings(bookings: DataFrame, messages: DataFrame) -> DataFrame:
    """Bookings for which no readable message exists (the row was
    committed, the publish failed).  ``messages`` are parsed (S3)."""
    sent = messages.where(F.col("parsed")).select(F.col("booking_id").alias("id"))
    return bookings.join(sent, "id", "left_anti")


__all__ = ["capture_price", "resolve_natural_keys", "user_id_by_email", "event_id_by_name", "remaining_confirmed", "orphan_bookings",
           "stats_existing_events", "inventory_drift", "unpublished_bookings", 
           "KEY_REMAINING_PREFIX"]
