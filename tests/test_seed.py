"""Seed golden table (FIXTURES.md §2) through S8, J3, A9, A3 and A5."""

from pyspark.sql import functions as F

from seatflow.operators import stats as A
from seatflow.sources.seed import load_seed

AS_OF = "2024-06-01T00:00:00Z"

# event: (confirmed, pending, cancelled, remaining confirmed, remaining held, revenue cents)
GOLDEN = {
    "Coldplay World Tour": (6, 0, 0, 49994, 49994, 75000),
    "NBA Finals Game 1": (1, 0, 0, 19999, 19999, 20000),
    "Hamilton Musical": (2, 0, 0, 1498, 1498, 36000),
    "Taylor Swift Eras Tour": (3, 0, 2, 69997, 69997, 45000),
    "Champions League Final": (1, 0, 1, 79999, 79999, 25000),
    "Summer Music Festival 2024": (3, 2, 1, 74997, 74995, 28500),
    "Ed Sheeran Mathematics Tour": (2, 0, 0, 11998, 11998, 17000),
    "Wimbledon Tennis Championship": (1, 0, 0, 39999, 39999, 12000),
    "Broadway on Tour - The Lion King": (0, 4, 0, 2500, 2496, 0),
    "Formula 1 Grand Prix": (2, 0, 0, 99998, 99998, 15000),
    "Jazz in the Park": (1, 0, 0, 4999, 4999, 0),
    "Comedy Night Special": (0, 3, 0, 800, 797, 0),
    "Classical Music Symphony": (2, 0, 0, 1998, 1998, 7000),
    "Metallica World Tour 2024": (0, 1, 0, 40000, 39999, 0),
    "VIP Broadway Experience": (2, 1, 0, 198, 197, 100000),
    "Super Bowl LVIII": (3, 0, 0, 74997, 74997, 24000),
    "New Year's Eve Celebration": (5, 0, 0, 29995, 29995, 32500),
}


def _seed(spark):
    return load_seed(spark, "2024-06-01 00:00:00")


def test_seed_golden_table(spark):
    s = _seed(spark)
    ev, bk = s["events"], s["bookings"]
    held = {r["id"]: r["remaining"] for r in A.remaining_held(ev, bk).collect()}
    stats = {r["event_id"]: r for r in A.event_stats(ev, bk).collect()}
    rows = ev.select("id", "name", "remaining").collect()
    assert len(rows) == 17
    for r in rows:
        conf, _pend, _canc, rem_c, rem_h, rev = GOLDEN[r["name"]]
        assert stats[r["id"]]["tickets_sold"] == conf, r["name"]
        assert r["remaining"] == rem_c, r["name"]
        assert held[r["id"]] == rem_h, r["name"]
        assert stats[r["id"]]["revenue_cents"] == rev, r["name"]
    assert sum(v[5] for v in GOLDEN.values()) == sum(s["revenue_cents"] for s in stats.values()) == 437000


def test_seed_summary(spark):
    s = _seed(spark)
    row = A.data_summary(s["users"], s["events"], s["bookings"], AS_OF).first().asDict()
    assert row == {"total_users": 12, "admin_users": 2, "regular_users": 10, "total_events": 17,
                   "upcoming_events": 11, "past_events": 6, "total_bookings": 24, "confirmed_bookings": 16,
                   "pending_bookings": 5, "cancelled_bookings": 3}
    js = A.data_summary_json(s["users"], s["events"], s["bookings"], AS_OF).first()[0]
    assert js.startswith('{"users":12,"admin_users":2,')


def test_seed_natural_keys_resolve(spark):
    s = _seed(spark)
    assert s["bookings"].where(F.col("user_id").isNull() | F.col("event_id").isNull()).count() == 0
    assert s["bookings"].select("id").distinct().count() == 24


def test_seed_rows_have_their_times(spark):
    s = _seed(spark)
    day = 86_400
    at = F.lit(AS_OF).cast("timestamp")

    def ages(df, col):
        return {r[0]: r[1] for r in df.select(col, ((F.unix_timestamp(at) - F.unix_timestamp(
            F.col("created_at").cast("timestamp"))) / day).cast("int")).collect()}
    made = ages(s["users"], "email")
    assert made["admin@example.org"] == 30 and made["olivia.taylor@example.com"] == 1
    assert ages(s["events"], "name")["Super Bowl LVIII"] == 75
    assert s["events"].where(F.col("updated_at") < F.col("created_at")).count() == 0
    assert s["users"].where(F.col("updated_at").cast("timestamp") != at).count() == 0
