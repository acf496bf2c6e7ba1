"""Streaming operators against their batch twins under random batch splits
result."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seatflow.operators import changes as C
from seatflow.operators import replay as W
from seatflow.streaming import operators as S
from seatflow.session import scratch_path
from seatflow.streaming.runner import SliceReplay, enable_state_store

T0 = datetime(2024, 1, 1)


def _commands(rng, n):
    caps = {f"e{i}": rng.randint(0, 20) for i in range(4)}
    rows = []
    for i in range(n):
        ev, q = f"e{rng.randrange(4)}", rng.randint(1, 8)
        ts = T0 + timedelta(minutes=rng.randint(0, 5000))
        rows.append((f"b{i:03d}", ev, q, ts, 0, "CREATE"))
        for seq in (1, 2):
            if rng.random() < 0.6:
                rows.append((f"b{i:03d}", ev, q, ts + timedelta(minutes=rng.randint(1, 40)), seq,
                             rng.choice(["CONFIRM", "CANCEL"])))
    return caps, rows


def _shuffled(rows, rng, k):
    """Slice numbers of rows that arrive up to a day late, in no order."""
    return [(*r, rng.randrange(k)) for r in rng.sample(rows, len(rows))]


def _append(run):
    return lambda out: out.writeStream.format("parquet").option("path", run.sink).outputMode("append")


CMD = "booking_id string, event_id string, quantity int, ts timestamp_ntz, seq int, command string"


def _beats(spark, n, days=20):
    return [spark.createDataFrame([("~", "~", 0, T0 + timedelta(days=days + i), 0, "CREATE")], CMD) for i in range(n)]


def _decided(df):
    return {(r["booking_id"], r["seq"], r["command"]): (r["applied"], r["remaining"]) for r in df.collect()}


@pytest.mark.parametrize("keep", [None, "30 days"])
def test_inventory_stream_equals_batch_on_shuffled_arrival(spark, keep):
    enable_state_store(spark)
    rng = random.Random(21)
    caps, rows = _commands(rng, 120)
    ev = spark.createDataFrame(list(caps.items()), "id string, capacity int")
    run = SliceReplay(spark, "twin-inventory")
    run.run(spark.createDataFrame(_shuffled(rows, rng, 3), CMD + ", _slice int"), "_slice", [0, 1, 2],
            lambda s: _append(run)(S.inventory_stream(s, ev, delay="10 days", keep=keep)), _beats(spark, 1))
    want = W.replay_inventory(spark.createDataFrame(rows, CMD), ev)
    assert _decided(spark.read.parquet(run.sink)) == _decided(want)


def test_expiry_stream_gives_seats_back_live(spark):
    """Equal to the batch: expired bookings cancelled, then the inventory
    replayed; a settlement at the deadline itself is in time."""
    enable_state_store(spark)
    rng = random.Random(9)
    caps, rows = _commands(rng, 100)
    rows += [("z1", "e0", 1, T0, 0, "CREATE"), ("z1", "e0", 1, T0 + timedelta(minutes=15), 1, "CONFIRM")]
    rows += [("z2", "e0", 1, T0, 0, "CREATE"), ("z2", "e0", 1, T0 + timedelta(minutes=15, seconds=1), 1, "CONFIRM")]
    ev = spark.createDataFrame(list(caps.items()), "id string, capacity int")
    run = SliceReplay(spark, "twin-expiry")
    run.run(spark.createDataFrame(_shuffled(rows, rng, 3), CMD + ", _slice int"), "_slice", [0, 1, 2],
            lambda s: _append(run)(S.inventory_stream(s, ev, delay="10 days", ttl="15 minutes")), _beats(spark, 2))
    cmds = spark.createDataFrame(rows, CMD)
    both = cmds.unionByName(S.expiry_cancels(S.expired_bookings(cmds), cmds))
    want = {k: v for k, v in _decided(W.replay_inventory(both, ev)).items() if v[0] or k[1] > 0 or k[2] == "CREATE"}
    got = _decided(spark.read.parquet(run.sink))
    assert got == want and any(k[1:] == (0, "CANCEL") for k in got) and ("z1", 0, "CANCEL") not in got
    with pytest.raises(ValueError):
        S.inventory_stream(cmds, ev, ttl="15 minutes", width_ms=3_600_000)


def test_booking_state_is_freed_and_a_forgotten_booking_stays_so(spark):
    enable_state_store(spark)
    ev = spark.createDataFrame([("e", 100)], "id string, capacity int")
    rows = [(f"b{i:02}", "e", 1, T0 + timedelta(minutes=i), 0, "CREATE", 0) for i in range(40)]
    late = T0 + timedelta(days=3)
    rows += [("b00", "e", 1, late, 1, "CANCEL", 1), ("c", "e", 1, late, 0, "CREATE", 1),
             ("c", "e", 1, late + timedelta(hours=1), 1, "CANCEL", 1)]
    src = spark.createDataFrame(rows, CMD + ", _slice int")

    def run(keep):
        r = SliceReplay(spark, "state-release")
        r.run(src, "_slice", [0, 1], lambda s: _append(r)(S.inventory_stream(s, ev, keep=keep)), _beats(spark, 2))
        got = _decided(spark.read.parquet(r.sink))
        return r.batches[-1]["state_rows"], got["b00", 1, "CANCEL"], got["c", 1, "CANCEL"]

    kept, cancel, recent = run(None)
    assert cancel == (True, 61) and recent == (True, 61)
    freed, cancel, recent = run("2 days")  # 40 bookings without a command for two days are gone
    assert freed <= kept - 40 and cancel == (False, 60) and recent == (True, 60)


def test_rate_limit_stream_equals_batch_on_shuffled_arrival(spark):
    enable_state_store(spark)
    rng = random.Random(8)
    rows = [(f"q{i:03d}", f"10.0.0.{rng.randrange(3)}", T0 + timedelta(seconds=rng.randint(0, 4 * 3600)))
            for i in range(150)]
    schema = "request_id string, client_ip string, ts timestamp_ntz"
    token_us, burst = 600_000_000, 3
    run = SliceReplay(spark, "twin-rate")
    beat = spark.createDataFrame([("~", "~", T0 + timedelta(days=9))], schema)
    run.run(spark.createDataFrame(_shuffled(rows, rng, 2), schema + ", _slice int"), "_slice", [0, 1],
            lambda s: _append(run)(S.rate_limit_stream(s, "client_ip", token_us, burst, delay="1 day")), [beat])

    def tokens(df):
        return {r["request_id"]: (r["allowed"], r["tokens"]) for r in df.collect()}
    assert tokens(spark.read.parquet(run.sink)) == tokens(W.replay_rate_limit(
        spark.createDataFrame(rows, schema), "client_ip", token_us, burst))


def test_admit_stream_equals_batch_on_shuffled_arrival(spark):
    enable_state_store(spark)
    rng = random.Random(5)
    schema = "id string, event_id string, quantity int, created_at timestamp_ntz"
    rows = [(f"r{i:03}", f"e{rng.randrange(4)}", rng.randint(1, 5), T0 + timedelta(minutes=rng.randrange(900)))
            for i in range(200)]
    ev = spark.createDataFrame([(f"e{k}", 60) for k in range(3)], "id string, capacity int")
    run = SliceReplay(spark, "twin-admit")
    beat = spark.createDataFrame([("~", "~", 0, T0 + timedelta(days=9))], schema)
    run.run(spark.createDataFrame(_shuffled(rows, rng, 3), schema + ", _slice int"), "_slice", [0, 1, 2],
            lambda s: _append(run)(S.admit_stream(s, ev, delay="1 day")), [beat])

    def left(df):
        return {r["id"]: (r["admitted"], r["remaining"], r["reason"]) for r in df.collect()}
    assert left(spark.read.parquet(run.sink)) == left(W.admit(spark.createDataFrame(rows, schema), ev))
    seats = {r["key"]: r["remaining"] for r in S.live_counters(spark, run.checkpoint).collect()}
    after = [r for r in spark.read.parquet(run.sink).collect() if r["event_id"] == "e1"]
    assert seats["event:remaining:e1"] == min(r["remaining"] for r in after) and len(seats) == 3


def test_failed_confirmation_cancels_and_documents_follow(spark):
    enable_state_store(spark)
    schema = "ts timestamp_ntz, copy int, body string"

    def msg(b, q, minute, copy=0):
        return (T0 + timedelta(minutes=minute), copy,
                json.dumps({"booking_id": b, "user_id": "u", "event_id": "e", "quantity": q}))

    # a: confirmed twice; b: fails; c: fails, then confirmed after all; nobody's: unknown; unreadable
    said = [msg("a", 2, 1), msg("a", 2, 2, 1), msg("b", 9, 1), msg("c", 9, 1), msg("c", 3, 9, 1), msg("nobody", 1, 1),
            (T0, 0, "invalid json"), (T0, 1, "invalid json"), (T0, 0, json.dumps({"booking_id": "", "quantity": 1}))]
    bookings = spark.createDataFrame([(b, "e", q, 150, "PENDING") for b, q in (("a", 2), ("b", 9), ("c", 3), ("d", 1))],
                                     "id string, event_id string, quantity int, unit_price_cents int, status string")
    run = SliceReplay(spark, "settle-or-cancel")
    slices = [0, 0, 1, 1, 0, 1, 0, 1, 1]  # c is confirmed in the first batch, its failure comes in the second
    src = spark.createDataFrame([(*r, s) for r, s in zip(said, slices)], schema + ", _slice int")
    beat = spark.createDataFrame([msg("~", 1, 9000)], schema)
    run.run(src, "_slice", [0, 1], lambda s: _append(run)(S.settle_or_cancel(
        s, bookings, F.col("quantity") > 8, delay="1 day")), [beat])
    out = spark.read.parquet(run.sink)
    assert sorted((r["booking_id"], r["from_status"], r["to_status"]) for r in out.where("reason IS NULL").collect()) == [
        ("a", "PENDING", "CONFIRMED"), ("b", "PENDING", "CANCELLED"), ("c", "CANCELLED", "CONFIRMED"),
        ("c", "PENDING", "CANCELLED")]
    assert sorted(r["reason"] for r in out.where("reason IS NOT NULL").collect()) == [
        "UNKNOWN_BOOKING", "body:invalid_json", "body:invalid_json",
        "booking_id:required,user_id:required,event_id:required"]
    events = spark.createDataFrame([("e", 20, 5)], "id string, capacity int, remaining int")
    assert C.release_cancelled(events, out.where("reason IS NULL")).first()["remaining"] == 17
    docs = SliceReplay(spark, "documents")
    docs.run(out.withColumn("_slice", F.when(F.col("booking_id") == "c", 1).otherwise(0)), "_slice", [0, 1],
             lambda s: S.stats_stream(s, docs.sink))
    assert [r["value"] for r in S.latest_documents(spark.read.parquet(docs.sink)).collect()] == [
        '{"revenue":7.5,"tickets_sold":5}']


def test_two_level_dedupe_keeps_late_first_copies_and_bounds_its_state(spark):
    enable_state_store(spark)
    rows = [(f"k{i}", i, 0) for i in range(60)] + [("a", 1, 0), ("a", 1, 0)]
    rows += [(f"m{i}", i, 1) for i in range(5)] + [("k7", 7, 1)]
    rows += [("late", 3, 2), ("k9", 9, 2), ("a", 1, 2), (None, 0, 2)] + [("k1", 1, 3), (None, 0, 3), ("new", 5, 3)]
    src = spark.createDataFrame(rows, "booking_id string, quantity int, _slice int")
    run = SliceReplay(spark, "two-level")
    sink = S.SeenKeys(spark, run.sink)
    run.run(src, "_slice", [0, 1, 2, 3], lambda s: S.dedupe_stream(s, sink, "0 seconds"))
    got = sorted(str(r["booking_id"]) for r in sink.result().collect())
    assert got == sorted({str(r[0]) for r in rows})
    assert run.batches[0]["state_rows"] >= 61 and run.batches[-1]["state_rows"] <= 10  # keys of the last batches only
    again = spark.createDataFrame([("new", 5), ("k1", 1), ("other", 2)], "booking_id string, quantity int")
    for _ in range(2):  # a batch that is tried again overwrites its own part
        sink(again, 9)
    assert sorted(str(r["booking_id"]) for r in sink.result().collect()) == sorted([*got, "other"])


def test_folded_gauges_give_the_same_latest_values(spark):
    rows = [("m", f"e{i % 3}", float(i), T0 + timedelta(minutes=i), i) for i in range(12)]
    samples = spark.createDataFrame(rows, "metric string, event_id string, value double, ts timestamp_ntz, batch_id int")
    folded = S.fold_gauges(samples, scratch_path(spark, "folded"), 8)
    assert folded.count() == 3 + 3
    assert sorted(map(tuple, S.latest_gauges(folded).collect())) == sorted(map(tuple, S.latest_gauges(samples).collect()))


def test_late_rows_by_the_watermark_spark_reports(spark):
    rows = [("a", T0 + timedelta(days=2), 0), ("b", T0 + timedelta(days=2), 1), ("c", T0, 1), ("d", None, 1),
            ("e", T0 + timedelta(days=2) - timedelta(minutes=15), 1), ("f", T0 + timedelta(days=1, hours=23, minutes=50), 2)]
    src = spark.createDataFrame(rows, "id string, ts timestamp_ntz, _slice int")
    run = SliceReplay(spark, "late")
    run.run(src, "_slice", [0, 1, 2], lambda s: S.log_arrivals(s, run.sink))
    assert [b["batch_id"] for b in run.batches] == [0, 1, 2]
    late, on_time = S.split_late(spark.read.parquet(run.sink), run.watermarks())
    assert sorted(r["id"] for r in late.collect()) == ["c", "e"]
    assert sorted(r["id"] for r in on_time.collect()) == ["a", "b", "d", "f"]


def test_settle_sink_batches_and_compaction(spark):
    b = spark.createDataFrame([(f"b{i}", "2024-01-01 10:00:00") for i in range(3)], "id string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz")) \
        .withColumn("status", F.lit("PENDING")).withColumn("updated_at", F.col("created_at"))
    base = scratch_path(spark, "settle")

    def msgs(ids, minute):
        rows = [(json.dumps({"booking_id": i, "user_id": "u", "event_id": "e", "quantity": 1}), 0,
                 T0 + timedelta(minutes=minute)) for i in ids] + [("invalid json", 0, T0)]
        from seatflow.sources.messages import parse_booking_messages
        return parse_booking_messages(spark.createDataFrame(rows, "body string, copy int, ts timestamp_ntz"))

    sink = S.SettleSink(b, f"{base}/log")
    sink(msgs(["b0", "nope"], 1), 0)
    sink(msgs(["b0"], 2), 1)  # repeated confirm: no change
    sink(msgs(["b0"], 2), 1)  # the same batch again
    refused = sorted(r["reason"] for r in sink.rejects().collect())
    sink = sink.compact(f"{base}/base1", f"{base}/log1")
    sink(msgs(["b1"], 3), 2)
    got = {r["id"]: (r["status"], r["updated_at"].minute) for r in sink.current().collect()}
    assert got == {"b0": ("CONFIRMED", 1), "b1": ("CONFIRMED", 3), "b2": ("PENDING", 0)}
    assert refused == ["UNKNOWN_BOOKING", "body:invalid_json", "body:invalid_json"]
