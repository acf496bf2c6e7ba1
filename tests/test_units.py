"""The reference's own unit cases (FIXTURES.md §2) as set-wise checks."""

import json

from pyspark.sql import functions as F

from seatflow.operators import replay as W
from seatflow.operators import select as P
from seatflow.operators import validate as V
from seatflow.operators.changes import patch_profiles
from seatflow.sources.messages import booking_messages, parse_booking_messages


def _msgs(spark, bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")


def test_bad_json_is_rejected(spark):
    out = V.validate_messages(parse_booking_messages(_msgs(spark, ["invalid json"]))).first()
    assert out["parsed"] is False and out["errors"] == ["body:invalid_json"]


def test_message_rule(spark):
    good = {"booking_id": "b1", "user_id": "u1", "event_id": "e1", "quantity": 2}
    cases = [good, dict(good, booking_id=""), dict(good, user_id=""), dict(good, quantity=0)]
    rows = V.validate_messages(parse_booking_messages(_msgs(spark, [json.dumps(c) for c in cases]))) \
        .orderBy("n").select("errors").collect()
    assert [r[0] for r in rows] == [[], ["booking_id:required"], ["user_id:required"], ["quantity:positive"]]


def test_message_round_trip(spark):
    b = spark.createDataFrame([("b1", "u1", "e1", 3)], "id string, user_id string, event_id string, quantity int")
    m = booking_messages(b)
    back = parse_booking_messages(m.select("body")).first()
    assert m.first()["routing_key"] == "booking.created"
    assert (back["booking_id"], back["user_id"], back["event_id"], back["quantity"], back["parsed"]) == \
        ("b1", "u1", "e1", 3, True)


def test_quantity_rule(spark):
    ev = "0f8fad5b-d9cb-469f-a165-70867728950e"
    rows = [(str(q), "u", ev, q) for q in (-1, 0, 1, 2, 10, 11, 1000)]
    df = spark.createDataFrame(rows, "id string, user_id string, event_id string, quantity int")
    ok = {r["quantity"]: r["errors"] for r in V.validate_bookings(df).collect()}
    assert ok[1] == ok[2] == ok[10] == []
    assert ok[-1] == ["quantity:min"] and ok[0] == ["quantity:required"]
    assert ok[11] == ok[1000] == ["quantity:max"]


def test_uuid_version_checked(spark):
    df = spark.createDataFrame([("a", "u", "0f8fad5b-d9cb-169f-a165-70867728950e", 1)],
                               "id string, user_id string, event_id string, quantity int")
    assert V.validate_bookings(df).first()["errors"] == ["event_id:uuid4"]


def test_reserve_accepted_then_refused(spark):
    # 10 seats: taking 2 leaves 8; then taking 10 would leave -2, so it is
    # refused and nothing is taken
    ev = spark.createDataFrame([("e", 10)], "id string, capacity int")
    req = spark.createDataFrame([("r1", "e", 2, "2024-01-01 00:00:00"), ("r2", "e", 10, "2024-01-01 00:01:00")],
                                "id string, event_id string, quantity int, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    out = {r["id"]: r for r in W.admit(req, ev).collect()}
    assert out["r1"]["admitted"] and out["r1"]["remaining"] == 8
    assert not out["r2"]["admitted"] and out["r2"]["remaining"] == 8


def test_unknown_event_refused(spark):
    ev = spark.createDataFrame([("e", 10)], "id string, capacity int")
    req = spark.createDataFrame([("r1", "nope", 1, "2024-01-01 00:00:00")],
                                "id string, event_id string, quantity int, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    r = W.admit(req, ev).first()
    assert not r["admitted"] and r["reason"] == W.UNKNOWN_EVENT


def test_profile_owner_rule(spark):
    users = spark.createDataFrame([("u1", "a@x.io", "USER", "Old")], "id string, email string, role string, "
                                                                      "full_name string")
    patches = spark.createDataFrame([("u1", "u2", "New"), ("u1", "u1", "Newer")],
                                    "target_id string, caller_id string, full_name string")
    after, res = patch_profiles(users, patches)
    outcomes = {r["caller_id"]: r["outcome"] for r in res.collect()}
    assert outcomes == {"u2": "forbidden", "u1": "updated"}
    assert after.first()["full_name"] == "Newer"


def test_page_arguments():
    assert P.normalise_page("x", -5) == (20, 0)
    assert P.normalise_page(0, 3) == (20, 3)
    assert P.normalise_page(500, 1) == (100, 1)
    assert P.normalise_page("7", "2") == (7, 2)
