"""Change sets applied to table snapshots.

Each function takes the current snapshot and a set of changes and returns
the next snapshot (plus side outputs); writing it to a new path and
swapping is the caller's choice (``write_snapshot``).  Every step is a join
or an aggregate on the key, so a change set of any size costs one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatflow.operators.joins import capture_price
from seatflow.operators.replay import admit
from seatflow.operators.validate import (split_valid, validate_bookings, validate_event_patches,
                                         validate_new_events, validate_profiles, validate_registrations)
from seatflow.schemas import CANCELLED, CONFIRMED, PENDING, ROLE_USER
from seatflow.session import reliable_checkpoint
from seatflow.sources.messages import booking_messages


NO_PRICE = "NO_PRICE"


# --------------------------------------------------------------------- C1
@dataclass
class BookingBatch:
    bookings: DataFrame   # new PENDING rows with the captured unit price
    events: DataFrame     # events with remaining reduced by the admitted seats
    refusals: DataFrame   # invalid or refused requests with their reason
    messages: DataFrame   # one booking.created message per new booking


def book_batch(requests: DataFrame, events: DataFrame, prices: DataFrame,
               id_format: str | None = "uuid4") -> BookingBatch:
    """Validate (P8), capture the price in force at the request time (J1),
    admit in arrival order (W1), insert PENDING rows and take the seats.  A
    request is all or nothing; one for a known event without a price in force
    is refused (NO_PRICE) before it could take seats.  ``requests``: id, user_id, event_id,
    quantity, created_at."""
    good, bad = split_valid(validate_bookings(requests, id_format))
    # the valid ones are stored, since putting rows in order reads its input twice (to sample it first);
    # the invalid ones are only read for the refusals
    good = reliable_checkpoint(good, "booking-requests")
    known = events.select(F.col("id").alias("event_id"), F.lit(True).alias("_known"))
    priced = capture_price(good.select("id", "user_id", "event_id", "quantity", "created_at"), prices).join(
        known, "event_id", "left")
    priced = reliable_checkpoint(priced, "priced-requests")
    no_price = F.col("_known").isNotNull() & F.col("unit_price_cents").isNull()
    asked = priced.where(~no_price).drop("_known")
    unpriced = priced.where(no_price).select("id", "user_id", "event_id", "quantity", F.lit(NO_PRICE).alias("reason"))
    # one decided table, read by all four outputs
    decided = reliable_checkpoint(admit(asked, events).unionByName(unpriced, allowMissingColumns=True), "booked")
    admitted = decided.where("admitted")
    new = admitted.select("id", "user_id", "event_id", "quantity", "unit_price_cents",
                        F.lit(PENDING).alias("status"), "created_at", F.col("created_at").alias("updated_at"))
    taken = admitted.groupBy("event_id").agg(F.sum("quantity").cast("bigint").alias("_taken"))
    ev = (events.join(taken.withColumnRenamed("event_id", "id"), "id", "left")
          .withColumn("remaining", (F.col("remaining") - F.coalesce("_taken", F.lit(0))).cast("int"))
          .drop("_taken"))
    refused = decided.where(F.col("reason").isNotNull()).select("id", "user_id", "event_id", "quantity", "reason")
    invalid = bad.select("id", "user_id", "event_id", "quantity",
                         F.concat_ws(",", "errors").alias("reason"))
    return BookingBatch(new, ev, invalid.unionByName(refused), booking_messages(new))


# --------------------------------------------------------------------- C2
def apply_status(bookings: DataFrame, commands: DataFrame) -> DataFrame:
    """Status and updated_at after the CONFIRM / CANCEL commands.

    The stored row is the first state; commands follow in (ts, seq) order.
    A repeated command changes nothing (updated_at stays at the last real
    change); a command for an unknown booking changes nothing and is no
    error.

    The commands alone give the last run of equal targets per booking: its
    target, its start, and whether it is the only run.  It is the last real
    change unless it is the only one and repeats the stored status.  So each
    side is read once, and only the commands pass through a window.
    """
    target = F.when(F.col("command") == "CONFIRM", F.lit(CONFIRMED)).when(
        F.col("command") == "CANCEL", F.lit(CANCELLED))
    cmd = commands.where(F.col("command").isin("CONFIRM", "CANCEL")).select(
        F.col("booking_id").alias("id"), target.alias("_target"), "ts", F.col("seq").cast("int").alias("seq"))
    prev = F.lag("_target").over(Window.partitionBy("id").orderBy("ts", "seq"))
    starts = cmd.withColumn("_prev", prev).where(F.col("_prev").isNull() | (F.col("_prev") != F.col("_target")))
    runs = starts.groupBy("id").agg(F.max_by(F.struct("_target", "ts"), F.struct("ts", "seq")).alias("_last"),
                                    F.count(F.lit(1)).alias("_runs"))
    stays = F.col("_runs").isNull() | ((F.col("_runs") == 1) & F.col("_last._target").eqNullSafe(F.col("status")))
    out = bookings.join(runs, "id", "left").withColumn("_stays", stays)
    return (out.withColumn("status", F.when(F.col("_stays"), F.col("status")).otherwise(F.col("_last._target")))
            .withColumn("updated_at", F.when(F.col("_stays"), F.col("updated_at")).otherwise(
                F.coalesce("_last.ts", "updated_at")))
            .select(*bookings.columns))


# --------------------------------------------------------------------- C3
def release_cancelled(events: DataFrame, transitions: DataFrame) -> DataFrame:
    """Give back the seats of bookings that moved into CANCELLED, at most
    up to capacity (updated_at untouched, as the service's update leaves it).
    Releasing the sum at once equals releasing one by one, because only the
    additions are clamped."""
    back = (transitions.where(F.col("to_status") == CANCELLED)
            .groupBy(F.col("event_id").alias("id")).agg(F.sum("quantity").cast("bigint").alias("_back")))
    out = events.join(back, "id", "left")
    return (out.withColumn("remaining", F.least(F.col("remaining") + F.coalesce("_back", F.lit(0)),
                                                F.col("capacity")).cast("int"))
            .drop("_back").select(*events.columns))


# --------------------------------------------------------------------- C4
def create_events(events: DataFrame, new: DataFrame, allow_free: bool = False) -> tuple[DataFrame, DataFrame]:
    """C4: valid new events (P9) join the table with remaining = capacity.
    Returns (table, refused rows with ``errors``).  The table keeps all its
    columns (new rows have NULL in those they lack); an id that the table
    holds, or that an earlier new row (by name) has, is refused."""
    good, bad = split_valid(validate_new_events(new, allow_free))
    held = events.select(F.col("id").alias("_held")).distinct()
    turn = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    marked = good.withColumn("_turn", turn).join(held, F.col("id") == F.col("_held"), "left")
    clash = F.col("_held").isNotNull() | (F.col("id").isNotNull() & (F.col("_turn") > 1))
    again = marked.where(clash).drop("_turn", "_held").withColumn("errors", F.array(F.lit("id:exists")))
    add = marked.where(~clash).drop("_turn", "_held").withColumn("remaining", F.col("capacity"))
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in add.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    return events.unionByName(add.select(*cols)), bad.unionByName(again, allowMissingColumns=True)


# --------------------------------------------------------------------- C5
def _touched(rows: DataFrame, hit: str, at: Column | None) -> DataFrame:
    """``updated_at`` set to ``at`` where ``hit``, if there is such a column."""
    if at is None or "updated_at" not in rows.columns:
        return rows
    when = at.cast(rows.schema["updated_at"].dataType)
    return rows.withColumn("updated_at", F.when(F.col(hit), when).otherwise(F.col("updated_at")))


def patch_outcomes(events: DataFrame, patches: DataFrame) -> DataFrame:
    """C5, second output: every patch with ``invalid`` (P10), ``not_found`` or
    ``updated``."""
    known = events.select("id", F.lit(True).alias("_known")).dropDuplicates(["id"])
    outcome = F.when(F.size("errors") > 0, "invalid").when(F.col("_known").isNull(), "not_found").otherwise("updated")
    return validate_event_patches(patches).join(known, "id", "left").select(*patches.columns, outcome.alias("outcome"))


def patch_events(events: DataFrame, patches: DataFrame, clamp_remaining: bool = False,
                 order: str | None = None, at: Column | None = None) -> DataFrame:
    """Absent (NULL) patch fields keep the old value.  As coded, a
    smaller capacity leaves ``remaining`` as it was (it may exceed capacity);
    ``clamp_remaining`` repairs that.  Invalid patches (P10) are skipped.
    created_at is kept; ``at`` (the time of the change set) becomes updated_at
    of the patched events.  Of several patches of one event each field takes the
    last value given, by the ``order`` column (without one, the largest)."""
    good, _ = split_valid(validate_event_patches(patches))
    fields = [c for c in ("name", "description", "starts_at", "ends_at", "capacity", "ticket_price_cents")
              if c in good.columns]
    p = good.groupBy("id").agg(*[
        (F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)).alias(f"_p_{c}")
        for c in fields], F.lit(True).alias("_p_hit"))
    out = events.join(p, "id", "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_p_{c}", c))
    if clamp_remaining:
        out = out.withColumn("remaining", F.least("remaining", "capacity"))
    return _touched(out, "_p_hit", at).select(*events.columns)


# --------------------------------------------------------------------- C6
def delete_events(events: DataFrame, ids: DataFrame, bookings: DataFrame,
                  ids_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table without the deleted events, ids blocked because bookings
    refer to them).  Deleting an absent id succeeds and does nothing."""
    want = ids.select(F.col(ids_key or ids.columns[0]).alias("id")).distinct()
    used = bookings.select(F.col("event_id").alias("id"))
    blocked = want.join(used, "id", "left_semi")
    gone = want.join(blocked, "id", "left_anti")
    return events.join(gone, "id", "left_anti"), blocked


# --------------------------------------------------------------------- C7
def register_users(users: DataFrame, new: DataFrame, order_col: str = "request_id") -> DataFrame:
    """One outcome per registration: ``invalid`` (P12), ``conflict``
    (e-mail taken, or an earlier request in the batch has it) or
    ``created`` (role USER, id = request id).

    The first request per e-mail comes from a grouped ``min`` (partial
    aggregation, skew-safe) joined back, not from a window over one e-mail.
    """
    checked = validate_registrations(new)
    valid = F.size("errors") == 0
    ok = checked.where(valid)
    first = ok.groupBy("email").agg(F.min(order_col).alias("_first"))
    taken = users.select("email").distinct().withColumn("_taken", F.lit(True))
    j = ok.join(first, "email").join(taken, "email", "left")
    outcome = F.when(F.col("_taken").isNotNull() | (F.col(order_col) != F.col("_first")), F.lit("conflict")) \
               .otherwise(F.lit("created"))
    good = j.select(*new.columns, outcome.alias("outcome"))
    bad = checked.where(~valid).select(*new.columns, F.lit("invalid").alias("outcome"))
    return good.unionByName(bad)


def new_users(outcomes: DataFrame, id_col: str = "request_id", at: Column | None = None) -> DataFrame:
    """The user rows the created outcomes add; ``at`` (the time of the
    change set) becomes their created_at and updated_at."""
    when = (F.lit(None) if at is None else at).cast("timestamp")
    return outcomes.where(F.col("outcome") == "created").select(
        F.col(id_col).alias("id"), "email", F.lit(ROLE_USER).alias("role"),
        F.lit(None).cast("string").alias("full_name"), when.alias("created_at"), when.alias("updated_at"))


# --------------------------------------------------------------------- C8
def patch_profiles(users: DataFrame, patches: DataFrame, order: str | None = None,
                   at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(users after the patches, one outcome per patch).

    Outcomes: ``forbidden`` (caller is not the target, or no caller),
    ``invalid`` (P12 profile rule), ``not_found`` (unknown target) or
    ``updated``.  Unlike C5, an absent full_name sets NULL.  Of several
    patches of one user the last by ``order`` counts (without one, the largest
    name).  ``at`` (the time of the change set) becomes updated_at of the
    patched users.
    """
    c, t = F.col("caller_id"), F.col("target_id")
    checked = validate_profiles(patches)
    known = users.select(F.col("id").alias("target_id"), F.lit(True).alias("_known")).dropDuplicates(["target_id"])
    j = checked.join(known, "target_id", "left")
    outcome = (F.when(c.isNull() | (c == "") | (c != t), F.lit("forbidden"))
                .when(F.size("errors") > 0, F.lit("invalid"))
                .when(F.col("_known").isNull(), F.lit("not_found"))
                .otherwise(F.lit("updated")))
    res = j.select(*patches.columns, outcome.alias("outcome"))
    last = F.max(F.struct(*([order] if order else []), "full_name"))["full_name"]
    upd = res.where(F.col("outcome") == "updated").groupBy(F.col("target_id").alias("id")).agg(
        last.alias("_new_name"), F.lit(True).alias("_hit"))
    out = users.join(upd, "id", "left").withColumn(
        "full_name", F.when(F.col("_hit"), F.col("_new_name")).otherwise(F.col("full_name")))
    return _touched(out, "_hit", at).select(*users.columns), res


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new snapshot to a fresh ``path`` (the caller swaps the pointer
    after success, so readers never see half a table)."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
