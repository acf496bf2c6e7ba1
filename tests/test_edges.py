"""Rows off the fixtures: nothing is lost, no key doubles."""

import datetime as dt

import pytest

from seatflow.operators import changes, joins, replay, select, stats
from seatflow.sources.tables import parse_access_lines
from seatflow.session import scratch_path
from seatflow.streaming import operators as S
from seatflow.streaming.operators import RateLimitProcessor
from seatflow.streaming.runner import SliceReplay, enable_state_store

T0 = dt.datetime(2024, 1, 1)


def test_admit_keeps_rows_without_time_or_event(spark):
    req = spark.createDataFrame([("a", "e", 1, T0), ("b", "e", 1, None), ("c", None, 1, T0)],
                                "id string, event_id string, quantity int, created_at timestamp_ntz")
    ev = spark.createDataFrame([("e", 5)], "id string, capacity int")
    got = {r["id"]: r for r in replay.admit(req, ev).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["c"]["reason"] == "UNKNOWN_EVENT" and got["a"]["admitted"] and got["b"]["admitted"]


def test_admit_burst_inside_one_minute(spark):
    rows = [(f"r{i:03d}", "hot" if i % 2 else f"e{i % 7}", 1 + i % 3, T0 + dt.timedelta(milliseconds=i))
            for i in range(200)]
    req = spark.createDataFrame(rows, "id string, event_id string, quantity int, created_at timestamp_ntz")
    ev = spark.createDataFrame([("hot", 50)] + [(f"e{i}", 9) for i in range(7)], "id string, capacity int")
    left, want = {"hot": 50} | {f"e{i}": 9 for i in range(7)}, {}
    for i, e, q, _ in rows:
        want[i] = q <= left[e]
        left[e] -= q if want[i] else 0
    assert {r["id"]: r["admitted"] for r in replay.admit(req, ev).collect()} == want


def _commands(spark, rows):
    return spark.createDataFrame(rows, "booking_id string, event_id string, quantity int, ts timestamp_ntz, "
                                       "seq int, command string")


def test_inventory_returns_commands_of_unknown_events(spark):
    cmd = _commands(spark, [("a", "e", 1, T0, 0, "CREATE"), ("b", "x", 1, T0, 0, "CREATE")])
    ev = spark.createDataFrame([("e", 5)], "id string, capacity int")
    got = {r["booking_id"]: r for r in replay.replay_inventory(cmd, ev).collect()}
    assert got["a"]["applied"] and not got["b"]["applied"] and got["b"]["remaining"] is None


def test_settle_without_create_is_rejected(spark):
    cmd = _commands(spark, [("a", "e", 1, T0, 0, "CREATE"), ("a", "e", 1, T0, 1, "CONFIRM"),
                            ("b", "e", 1, T0, 0, "CANCEL")])
    assert {r["booking_id"] for r in replay.status_transitions(cmd).collect()} == {"a"}
    assert [r["booking_id"] for r in replay.uncreated_commands(cmd).collect()] == ["b"]


EVENTS = "id string, name string, starts_at timestamp_ntz, ends_at timestamp_ntz, capacity int, remaining int, " \
         "ticket_price_cents bigint, created_at timestamp_ntz"


def test_create_events_keeps_columns_and_refuses_known_ids(spark):
    ev = spark.createDataFrame([("e1", "old", T0, T0, 5, 5, 100, T0)], EVENTS)
    new = spark.createDataFrame([("e1", "again", T0, T0, 5, 100), ("e2", "new", T0, T0, 7, 100)],
                                "id string, name string, starts_at timestamp_ntz, ends_at timestamp_ntz, "
                                "capacity int, ticket_price_cents bigint")
    table, bad = changes.create_events(ev, new)
    rows = {r["id"]: r for r in table.collect()}
    assert table.columns == ev.columns and table.count() == 2
    assert rows["e1"]["name"] == "old" and rows["e2"]["remaining"] == 7 and rows["e2"]["created_at"] is None
    assert [r["id"] for r in bad.collect()] == ["e1"]


def test_two_patches_of_one_event(spark):
    ev = spark.createDataFrame([("e1", "old", T0, T0, 5, 5, 100, T0)], EVENTS)
    p = spark.createDataFrame([(1, "e1", "first", 8, None), (2, "e1", "second", None, None), (3, "x", "n", 1, None),
                               (4, "e1", None, -1, None)],
                              "n int, id string, name string, capacity int, ticket_price_cents bigint")
    rows = changes.patch_events(ev, p, order="n").collect()
    assert [(r["name"], r["capacity"]) for r in rows] == [("second", 8)]
    assert sorted(r["outcome"] for r in changes.patch_outcomes(ev, p).collect()) == [
        "invalid", "not_found", "updated", "updated"]


def test_two_patches_of_one_profile(spark):
    users = spark.createDataFrame([("u", "old")], "id string, full_name string")
    p = spark.createDataFrame([(1, "u", "u", "first"), (2, "u", "u", "second")],
                              "n int, caller_id string, target_id string, full_name string")
    out, res = changes.patch_profiles(users, p, order="n")
    assert [r["full_name"] for r in out.collect()] == ["second"] and res.count() == 2


def test_a_key_held_twice_is_an_error(spark):
    users = spark.createDataFrame([("a", "x@y"), ("b", "x@y")], "id string, email string")
    rows = spark.createDataFrame([("x@y",)], "email string")
    with pytest.raises(Exception, match="not unique"):
        joins.user_id_by_email(rows, users).collect()


def test_malformed_time_keeps_its_line(spark):
    line = '{"ts": "not a time", "status": 200, "path": "/"}'
    got = parse_access_lines(spark.createDataFrame([(line,)], "value string")).collect()
    assert len(got) == 1 and got[0]["ts"] is None and got[0]["_corrupt_record"] == line


def test_page_arguments_are_ascii_integers():
    assert select.normalise_page(" 5 ", "1_0") == (20, 0)
    assert select.normalise_page("+5", "٣") == (5, 0)


def test_median_is_exact(spark):
    log = spark.createDataFrame([("/", 200, float(i % 1000)) for i in range(20001)],
                                "path string, status int, latency_ms double")
    log = log.selectExpr("*", "cast(null as string) as level", "'r' as request_id")
    vals = sorted(float(i % 1000) for i in range(20001))
    row = stats.access_severity(log).collect()[0]
    assert row["p50_latency_ms"] == vals[10000] and row["requests"] == 20001


def test_rate_limiter_clock_never_turns_back():
    class Value:
        held = (2_000_000, 60_000_000, 0)

        def exists(self):
            return True

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def deleteTimer(self, _):
            pass

        def registerTimer(self, _):
            pass

    p = RateLimitProcessor(500_000, 5)
    p.handle, p.bucket = Handle(), Value()
    out = list(p.step(("k",), [(0, "r")], None))
    assert out[0]["allowed"] and out[0]["tokens"] == 1_500_000 and p.bucket.held[1] == 60_000_000


def test_gauge_falls_when_a_confirmed_booking_is_cancelled(spark):
    rows = [("e", 2, 500, None, "PENDING", T0, 0), ("e", 2, 500, "PENDING", "CONFIRMED", T0, 0),
            ("f", 1, 300, "PENDING", "CONFIRMED", T0, 0), ("g", 1, 1, None, "PENDING", T0, 0),
            ("e", 2, 500, "CONFIRMED", "CANCELLED", T0 + dt.timedelta(hours=1), 1),
            ("f", 1, 300, "CONFIRMED", "CONFIRMED", T0 + dt.timedelta(hours=1), 1)]
    src = spark.createDataFrame(rows, "event_id string, quantity int, unit_price_cents long, from_status string, "
                                      "to_status string, ts timestamp_ntz, _slice int")
    run = SliceReplay(spark, "edge-gauges")
    run.run(src, "_slice", [0, 1], lambda s: S.gauge_stream(s, run.sink))
    samples = spark.read.parquet(run.sink)
    got = {(r["metric"], r["event_id"]): r["value"] for r in S.latest_gauges(samples).collect()}
    assert got == {("tickets_sold_total", "e"): 0.0, ("revenue_total", "e"): 0.0,
                   ("tickets_sold_total", "f"): 1.0, ("revenue_total", "f"): 3.0}
    # the time of a sample comes from the data
    assert {r["ts"] for r in samples.where("batch_id = 1").collect()} == {T0 + dt.timedelta(hours=1)}


def test_admit_stream_gives_the_columns_and_reasons_of_the_batch(spark):
    enable_state_store(spark)
    req = spark.createDataFrame([("a", "e", 1, T0), ("b", "e", 9, T0), ("c", "no", 1, T0), ("d", "e", 1, None)],
                                "id string, event_id string, quantity int, created_at timestamp_ntz")
    ev = spark.createDataFrame([("e", 5)], "id string, capacity int")
    run = SliceReplay(spark, "edge-admit")
    path = scratch_path(spark, "edge-admit-requests")
    req.write.parquet(path)
    beat = spark.createDataFrame([("~", "~", 0, T0 + dt.timedelta(days=1))], req.schema)
    run.run(spark.read.parquet(path).selectExpr("*", "0 AS _slice"), "_slice", [0],
            lambda s: S.admit_stream(s, ev).writeStream.format("parquet").option("path", run.sink), [beat])
    want = replay.admit(req, ev)
    got = spark.read.parquet(run.sink)
    assert got.columns == want.columns

    def rows(df):
        return sorted(map(str, df.collect()))
    assert rows(got) == rows(want)


def test_expiry_ignores_a_settlement_before_the_create(spark):
    cmds = _commands(spark, [("a", "e", 1, T0, 0, "CREATE"), ("a", "e", 1, T0 - dt.timedelta(minutes=1), 1, "CANCEL"),
                             ("b", "e", 1, T0, 0, "CREATE"), ("b", "e", 1, T0, 1, "CONFIRM")])
    assert [r["booking_id"] for r in S.expired_bookings(cmds).collect()] == ["a"]


def test_orphans_read_the_bookings_once(spark):
    path = scratch_path(spark, "edge-orphans")
    spark.createDataFrame([("1", "u", "e"), ("2", "x", "e"), ("3", "x", "y"), ("4", None, "e")],
                          "id string, user_id string, event_id string").write.parquet(path)
    users, events = spark.createDataFrame([("u",), ("u",)], "id string"), spark.createDataFrame([("e",)], "id string")
    out = joins.orphan_bookings(spark.read.parquet(path), users, events)
    assert sorted((r["id"], r["reason"]) for r in out.collect()) == [
        ("2", "MISSING_USER"), ("3", "MISSING_EVENT"), ("3", "MISSING_USER"), ("4", "MISSING_USER")]
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1


def test_apply_status_reads_the_bookings_once(spark):
    path = scratch_path(spark, "edge-status")
    later = [T0 + dt.timedelta(minutes=i) for i in range(5)]
    old = T0 - dt.timedelta(days=1)
    spark.createDataFrame([(str(i), s, old) for i, s in enumerate(["PENDING", "CONFIRMED", "CONFIRMED", "CANCELLED",
                                                                   "PENDING"])],
                          "id string, status string, updated_at timestamp_ntz").write.parquet(path)
    said = [("0", "CONFIRM", 1), ("0", "CONFIRM", 2), ("1", "CONFIRM", 1), ("2", "CANCEL", 1), ("2", "CONFIRM", 2),
            ("2", "CONFIRM", 3), ("3", "CONFIRM", 1), ("3", "CANCEL", 2), ("gone", "CANCEL", 1), ("4", "CREATE", 1)]
    cmds = _commands(spark, [(b, "e", 1, later[i], i, c) for b, c, i in said])
    out = changes.apply_status(spark.read.parquet(path), cmds)
    assert {r["id"]: (r["status"], r["updated_at"]) for r in out.collect()} == {
        "0": ("CONFIRMED", later[1]), "1": ("CONFIRMED", old), "2": ("CONFIRMED", later[2]),
        "3": ("CANCELLED", later[2]), "4": ("PENDING", old)}
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
