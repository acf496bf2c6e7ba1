"""The service's seed data as DataFrames.

Bookings name their user by e-mail and their event by name; they are
resolved with J2 and each event's ``remaining`` is recomputed with J3
(capacity minus CONFIRMED seats), as the seed script does.  Times are
relative to ``as_of`` (the script uses the clock); ids are repeatable
hashes of the natural keys instead of random uuids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.functions.columns import repeatable_id
from seatflow.operators.joins import remaining_confirmed, resolve_natural_keys

# ---- fixed values: the seed rows (must equal the service's seed) -----------
# users: (email, role, full name, days since created; updated at the seed time)
SEED_USERS = [
    ("admin@example.org", "ADMIN", "System Administrator", 30),
    ("manager@example.org", "ADMIN", "Event Manager", 25),
    ("john.doe@example.com", "USER", "John Doe", 20),
    ("jane.smith@example.com", "USER", "Jane Smith", 18),
    ("mike.johnson@example.com", "USER", "Mike Johnson", 15),
    ("sarah.wilson@example.com", "USER", "Sarah Wilson", 12),
    ("david.brown@example.com", "USER", "David Brown", 10),
    ("lisa.davis@example.com", "USER", "Lisa Davis", 8),
    ("alex.garcia@example.com", "USER", "Alex Garcia", 6),
    ("emma.martinez@example.com", "USER", "Emma Martinez", 4),
    ("ryan.anderson@example.com", "USER", "Ryan Anderson", 2),
    ("olivia.taylor@example.com", "USER", "Olivia Taylor", 1),
]
# events: (name, starts_at UTC, ends_at UTC, capacity, ticket price in cents, days since created, since updated)
SEED_EVENTS = [
    ("Coldplay World Tour", "2024-01-15 19:30:00", "2024-01-15 23:00:00", 50000, 12500, 60, 14),
    ("NBA Finals Game 1", "2024-02-01 20:00:00", "2024-02-01 22:30:00", 20000, 20000, 55, 13),
    ("Hamilton Musical", "2024-02-20 20:00:00", "2024-02-20 22:30:00", 1500, 18000, 50, 12),
    ("Taylor Swift Eras Tour", "2024-03-10 19:00:00", "2024-03-10 23:00:00", 70000, 15000, 45, 11),
    ("Champions League Final", "2024-03-25 21:00:00", "2024-03-25 23:30:00", 80000, 25000, 40, 10),
    ("Summer Music Festival 2024", "2024-07-15 12:00:00", "2024-07-17 23:00:00", 75000, 9500, 30, 0),
    ("Ed Sheeran Mathematics Tour", "2024-08-05 20:00:00", "2024-08-05 22:30:00", 12000, 8500, 25, 0),
    ("Wimbledon Tennis Championship", "2024-07-01 11:00:00", "2024-07-14 19:00:00", 40000, 12000, 20, 0),
    ("Broadway on Tour - The Lion King", "2024-09-15 19:30:00", "2024-09-15 22:00:00", 2500, 22000, 15, 0),
    ("Formula 1 Grand Prix", "2024-08-25 14:00:00", "2024-08-25 16:00:00", 100000, 7500, 10, 0),
    ("Jazz in the Park", "2024-06-20 18:00:00", "2024-06-20 21:00:00", 5000, 0, 5, 0),
    ("Comedy Night Special", "2024-08-30 20:00:00", "2024-08-30 22:00:00", 800, 4500, 3, 0),
    ("Classical Music Symphony", "2024-09-08 19:00:00", "2024-09-08 21:30:00", 2000, 3500, 2, 0),
    ("Metallica World Tour 2024", "2024-10-15 18:30:00", "2024-10-15 22:30:00", 40000, 11000, 35, 0),
    ("VIP Broadway Experience", "2024-11-05 16:00:00", "2024-11-05 22:00:00", 200, 50000, 28, 0),
    ("Super Bowl LVIII", "2024-02-11 18:30:00", "2024-02-11 22:30:00", 75000, 8000, 75, 16),
    ("New Year's Eve Celebration", "2024-12-31 20:00:00", "2025-01-01 01:00:00", 30000, 6500, 1, 0),
]
# bookings: (user e-mail, event name, quantity, status,
#            created minutes before as_of, updated minutes before as_of)
_D, _H = 1440, 60
SEED_BOOKINGS = [
    ("john.doe@example.com", "Coldplay World Tour", 2, "CONFIRMED", 50 * _D, 14 * _D),
    ("jane.smith@example.com", "Coldplay World Tour", 4, "CONFIRMED", 48 * _D, 14 * _D),
    ("mike.johnson@example.com", "NBA Finals Game 1", 1, "CONFIRMED", 45 * _D, 13 * _D),
    ("sarah.wilson@example.com", "Hamilton Musical", 2, "CONFIRMED", 42 * _D, 12 * _D),
    ("david.brown@example.com", "Taylor Swift Eras Tour", 3, "CONFIRMED", 40 * _D, 11 * _D),
    ("lisa.davis@example.com", "Champions League Final", 1, "CONFIRMED", 38 * _D, 10 * _D),
    ("alex.garcia@example.com", "Super Bowl LVIII", 2, "CONFIRMED", 70 * _D, 16 * _D),
    ("emma.martinez@example.com", "Super Bowl LVIII", 1, "CONFIRMED", 68 * _D, 16 * _D),
    ("john.doe@example.com", "Summer Music Festival 2024", 3, "CONFIRMED", 20 * _D, 1 * _D),
    ("jane.smith@example.com", "Ed Sheeran Mathematics Tour", 2, "CONFIRMED", 18 * _D, 2 * _D),
    ("mike.johnson@example.com", "Wimbledon Tennis Championship", 1, "CONFIRMED", 15 * _D, 3 * _D),
    ("sarah.wilson@example.com", "Broadway on Tour - The Lion King", 4, "PENDING", 12 * _D, 1 * _D),
    ("david.brown@example.com", "Formula 1 Grand Prix", 2, "CONFIRMED", 8 * _D, 2 * _D),
    ("lisa.davis@example.com", "Jazz in the Park", 1, "CONFIRMED", 3 * _D, 1 * _D),
    ("alex.garcia@example.com", "Comedy Night Special", 3, "PENDING", 2 * _D, 30),
    ("emma.martinez@example.com", "Classical Music Symphony", 2, "CONFIRMED", 1 * _D, 2 * _H),
    ("ryan.anderson@example.com", "Summer Music Festival 2024", 2, "PENDING", 1 * _H, 30),
    ("olivia.taylor@example.com", "Metallica World Tour 2024", 1, "PENDING", 45, 20),
    ("john.doe@example.com", "VIP Broadway Experience", 1, "PENDING", 2 * _H, 1 * _H),
    ("mike.johnson@example.com", "Taylor Swift Eras Tour", 2, "CANCELLED", 35 * _D, 11 * _D),
    ("sarah.wilson@example.com", "Champions League Final", 1, "CANCELLED", 32 * _D, 10 * _D),
    ("david.brown@example.com", "Summer Music Festival 2024", 1, "CANCELLED", 10 * _D, 5 * _D),
    ("admin@example.org", "VIP Broadway Experience", 2, "CONFIRMED", 25 * _D, 2 * _D),
    ("manager@example.org", "New Year's Eve Celebration", 5, "CONFIRMED", 20 * _D, 1 * _D),
]
# ---------------------------------------------------------------------------


def load_seed(spark: SparkSession, as_of: str = "2024-06-01 00:00:00") -> dict[str, DataFrame]:
    """Users, events (remaining recomputed) and bookings of the seed."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def ago(c: str):
        return now - F.make_dt_interval(F.lit(0), F.lit(0), F.col(c), F.lit(0))

    def days_ago(c: str):
        return now - F.make_dt_interval(F.col(c), F.lit(0), F.lit(0), F.lit(0))

    users = spark.createDataFrame(SEED_USERS, "email string, role string, full_name string, made int").select(
        repeatable_id("email").alias("id"), "email", "role", "full_name", days_ago("made").alias("created_at"),
        now.alias("updated_at"))
    events = spark.createDataFrame(
        SEED_EVENTS, "name string, starts_at string, ends_at string, capacity int, ticket_price_cents long, "
                     "made int, changed int"
    ).select(repeatable_id("name").alias("id"), "name", F.lit(None).cast("string").alias("description"),
             F.col("starts_at").cast("timestamp_ntz"), F.col("ends_at").cast("timestamp_ntz"),
             "capacity", "ticket_price_cents", days_ago("made").alias("created_at"),
             days_ago("changed").alias("updated_at"))
    rows = spark.createDataFrame(
        SEED_BOOKINGS, "email string, event_name string, quantity int, status string, created_ago int, "
                       "updated_ago int")
    resolved = resolve_natural_keys(rows, users, events)
    prices = events.select(F.col("id").alias("event_id"), F.col("ticket_price_cents").alias("unit_price_cents"))
    bookings = resolved.join(prices, "event_id", "left").select(
        repeatable_id("email", "event_name", "created_ago").alias("id"), "user_id", "event_id", "quantity",
        "unit_price_cents", "status", ago("created_ago").alias("created_at"), ago("updated_ago").alias("updated_at"))
    remaining = remaining_confirmed(events, bookings)
    return {"users": users, "events": events.join(remaining, "id"), "bookings": bookings}
