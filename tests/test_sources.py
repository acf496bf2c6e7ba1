"""Sources and sinks: round trips through files (S3-S7), the bookings layout,
snapshots, keyset paging and new user rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from seatflow.operators import select as P
from seatflow.operators.changes import new_users, register_users, write_snapshot
from seatflow.session import scratch_path
from seatflow.sources.documents import currency_text, gauge_samples, stats_documents, write_gauges, \
    write_stats_documents
from seatflow.sources.messages import booking_messages, read_booking_messages, write_booking_messages
from seatflow.sources.tables import read_access_log, read_table, write_bookings

BOOKINGS = [("b1", "u1", "e1", 2, 1500, "CONFIRMED", "2024-01-01 10:00:00", "2024-01-01 10:05:00"),
            ("b2", "u2", "e1", 1, 1500, "PENDING", "2024-01-02 11:00:00", "2024-01-02 11:00:00"),
            ("b3", "u1", "e2", 3, 990, "CANCELLED", "2024-01-02 12:00:00", "2024-01-02 12:30:00")]
SCHEMA = ("id string, user_id string, event_id string, quantity int, unit_price_cents long, status string, "
          "created_at string, updated_at string")


def _bookings(spark):
    return (spark.createDataFrame(BOOKINGS, SCHEMA)
            .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
            .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")))


def test_messages_round_trip_through_files(spark):
    path = scratch_path(spark, "msgs")
    write_booking_messages(booking_messages(_bookings(spark)).select("body"), path, fmt="parquet")
    back = read_booking_messages(spark, path).orderBy("booking_id").collect()
    assert [(r["booking_id"], r["quantity"], r["parsed"]) for r in back] == [("b1", 2, True), ("b2", 1, True),
                                                                              ("b3", 3, True)]


def test_bookings_layout_and_read(spark):
    path = scratch_path(spark, "bookings")
    write_bookings(_bookings(spark), path)
    back = read_table(spark, path, "bookings")
    assert back.count() == 3
    plan = back.where(F.col("created_date") == F.lit("2024-01-02").cast("date"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan and "created_date" in plan
    assert sorted(r["id"] for r in back.where("status = 'CONFIRMED'").collect()) == ["b1"]


def test_stats_documents_and_gauges(spark):
    stats = spark.createDataFrame([("e1", 3, 4500), ("e2", 0, 0), ("e3", 1, 1234)],
                                  "event_id string, tickets_sold long, revenue_cents long") \
        .withColumn("revenue", F.col("revenue_cents") / 100.0)
    docs = {r["key"]: json.loads(r["value"]) for r in stats_documents(stats).collect()}
    assert docs["event:e1:stats"] == {"revenue": 45, "tickets_sold": 3}
    assert docs["event:e3:stats"] == {"revenue": 12.34, "tickets_sold": 1}
    path = scratch_path(spark, "docs")
    write_stats_documents(stats_documents(stats), path)
    assert spark.read.parquet(path).count() == 3
    g = scratch_path(spark, "gauges")
    write_gauges(gauge_samples(stats, F.lit("2024-01-01 00:00:00").cast("timestamp")), g)
    assert spark.read.parquet(g).where("metric = 'revenue_total' AND event_id = 'e3'").first()["value"] == 12.34


def test_currency_text(spark):
    df = spark.createDataFrame([(0,), (5,), (50,), (75000,), (12340,), (12345,), (-105,)], "c long")
    assert [r[0] for r in df.select(currency_text("c")).collect()] == ["0", "0.05", "0.5", "750", "123.4",
                                                                       "123.45", "-1.05"]


def test_access_log_files(spark):
    path = scratch_path(spark, "access")
    lines = [json.dumps({"level": "warn", "ts": "2024-01-01T00:00:01.250Z", "msg": "x", "request_id": "r1",
                         "method": "GET", "path": "/api/v1/events", "status": 404, "latency": 1.5,
                         "client_ip": "10.0.0.1", "user_agent": "t"}), "not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    rows = read_access_log(spark, path).collect()
    good = [r for r in rows if r["_corrupt_record"] is None]
    assert len(rows) == 2 and len(good) == 1
    assert good[0]["status"] == 404 and good[0]["latency_ms"] == 1.5 and good[0]["user_id"] is None


def test_keyset_page_and_snapshot(spark):
    ev = spark.createDataFrame([(f"e{i}", f"2024-01-0{1 + i % 3} 00:00:00") for i in range(9)],
                               "id string, starts_at string") \
        .withColumn("starts_at", F.col("starts_at").cast("timestamp_ntz"))
    first = [r["id"] for r in P.page_events(ev, 4, 0).collect()]
    last = P.page_events(ev, 4, 0).collect()[-1]
    after = [r["id"] for r in P.page_events_after(ev, str(last["starts_at"]), last["id"], 4).collect()]
    assert first + after == [r["id"] for r in P.list_events(ev).collect()][:8]
    path = scratch_path(spark, "snap")
    write_snapshot(ev, path)
    assert spark.read.parquet(path).count() == 9


def test_new_users(spark):
    users = spark.createDataFrame([("u1", "a@x.io")], "id string, email string")
    reqs = spark.createDataFrame([("1", "b@x.io", 10), ("2", "b@x.io", 12), ("3", "a@x.io", 9), ("4", "bad", 9)],
                                 "request_id string, email string, password_length int")
    out = {r["request_id"]: r["outcome"] for r in register_users(users, reqs).collect()}
    assert out == {"1": "created", "2": "conflict", "3": "conflict", "4": "invalid"}
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    made = new_users(register_users(users, reqs), at=at).collect()
    assert [(r["id"], r["created_at"], r["updated_at"]) for r in made] == [("1", *[dt.datetime(2024, 6, 1)] * 2)]
