"""Order-dependent rules over stored ranges: bursts, borders, odd rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seatflow.operators import changes as C
from seatflow.operators import joins as J
from seatflow.operators import replay as W
from seatflow.operators import select as P
from seatflow.session import ranged
from seatflow.streaming import operators as S
from seatflow.streaming.runner import SliceReplay

T0 = dt.datetime(2024, 5, 1)
REQ = "id string, event_id string, quantity int, created_at timestamp_ntz"


def _burst(rng, n=600):
    """Half of the requests for one event, all in one second of one minute."""
    return [(f"r{i:04}", "hot", rng.randint(1, 4), T0) if i % 2 else
            (f"r{i:04}", f"e{rng.randint(0, 9)}", rng.randint(1, 4), T0 + dt.timedelta(hours=rng.randint(0, 99)))
            for i in range(n)]


def test_burst_is_spread_and_admitted_like_the_fold(spark):
    rows = _burst(random.Random(3))
    req = spark.createDataFrame(rows, REQ)
    parts = ranged(req, ["event_id", "created_at", "id"], "test", partitions=12).groupBy("_range").count().collect()
    assert len(parts) == 12 and max(r["count"] for r in parts) <= 150
    caps = {"hot": 400, **{f"e{k}": 30 for k in range(9)}}  # e9 is unknown
    got = {r["id"]: (r["admitted"], r["remaining"]) for r in W.admit(
        req, spark.createDataFrame(list(caps.items()), "id string, capacity int"), partitions=12).collect()}
    left = dict(caps)
    for i, e, q, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        ok = e in left and q <= left[e]
        if ok:
            left[e] -= q
        assert got[i] == (ok, left.get(e))


def test_price_in_force_against_brute_force(spark):
    rng = random.Random(5)
    rows = _burst(rng) + [("n1", None, 1, T0), ("n2", "hot", 1, None), ("n3", "hot", 1, dt.datetime(2020, 1, 1))]
    rows += rows[:2]
    prices = [(e, T0 + dt.timedelta(hours=h), None if (h == 40 and e == "e2") else rng.randint(100, 999))
              for e in ["hot", *(f"e{k}" for k in range(8))] for h in range(-60, 99, 20)] + [(None, T0, 5), ("e1", None, 7)]
    got = J.capture_price(spark.createDataFrame(rows, REQ), spark.createDataFrame(
        prices, "event_id string, valid_from timestamp_ntz, ticket_price_cents int"))
    assert got.columns == ["id", "event_id", "quantity", "created_at", "unit_price_cents"]

    def price(e, t):
        held = [(v, c) for pe, v, c in prices if t and e and pe == e and v and v <= t]
        return max(held, key=lambda x: x[0])[1] if held else None
    want = sorted((i, price(e, t)) for i, e, _, t in rows if price(e, t) is not None)
    have = [(r["id"], r["unit_price_cents"]) for r in got.collect()]
    assert len(have) == len(rows) and sorted(x for x in have if x[1] is not None) == want


def test_request_without_a_price_takes_no_seat(spark):
    req = spark.createDataFrame([("a", "u", "e", 2, T0 - dt.timedelta(days=1)), ("b", "u", "e", 3, T0),
                                 ("c", "u", "gone", 1, T0)],
                                "id string, user_id string, event_id string, quantity int, created_at timestamp_ntz")
    ev = spark.createDataFrame([("e", 4, 4)], "id string, capacity int, remaining int")
    prices = spark.createDataFrame([("e", T0, 50)], "event_id string, valid_from timestamp_ntz, ticket_price_cents int")
    out = C.book_batch(req, ev, prices, id_format=None)
    assert [(r["id"], r["unit_price_cents"]) for r in out.bookings.collect()] == [("b", 50)]
    assert {r["id"]: r["reason"] for r in out.refusals.collect()} == {"a": "NO_PRICE", "c": "UNKNOWN_EVENT"}
    assert out.events.first()["remaining"] == 1


def test_pages_behind_any_offset(spark):
    rng = random.Random(1)
    rows = [(f"{i:03}", T0 + dt.timedelta(hours=rng.randint(0, 60)) if i % 9 else None) for i in range(120)]
    ev = spark.createDataFrame(rows, "id string, starts_at timestamp_ntz")
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[0]))]
    for k in (0, 1, 13, 50, 115, 120, 10**9):
        assert [r["id"] for r in P.page_events(ev, 10, k).collect()] == order[k:k + 10], k


def test_fill_at_scrape_interval(spark):
    rows = [("e", "CONFIRMED", 2, 10, T0), ("e", "CONFIRMED", 1, 10, T0 + dt.timedelta(days=2, seconds=20)),
            ("f", "CONFIRMED", 1, 10, T0), ("e", "PENDING", 9, 10, T0 + dt.timedelta(days=9))]
    b = spark.createDataFrame(rows, "event_id string, status string, quantity int, unit_price_cents int, "
                                    "updated_at timestamp_ntz")
    got = W.gauge_series(b, "15 seconds", fill=True).where("event_id = 'e'")
    r = got.agg(F.count("bucket"), F.count_distinct("bucket"), F.min("bucket"), F.max("bucket"), F.max("tickets_total"),
                F.sum(F.col("tickets_total"))).first()
    n = 2 * 86400 // 15 + 2
    assert tuple(r) == (n, n, T0, T0 + dt.timedelta(days=2, seconds=15), 3, 2 * (n - 1) + 3)


def test_expiry_cancels_and_gives_seats_back(spark):
    rows = [("b1", "e", 2, T0, 0, "CREATE"), ("b2", "e", 3, T0, 0, "CREATE"),
            ("b2", "e", 3, T0 + dt.timedelta(minutes=15), 1, "CONFIRM")]
    cmds = spark.createDataFrame(rows, "booking_id string, event_id string, quantity int, ts timestamp_ntz, seq int, "
                                       "command string")
    cancels = S.expiry_cancels(S.expired_bookings(cmds), cmds)
    assert [tuple(r) for r in cancels.collect()] == [("b1", "e", 2, T0 + dt.timedelta(minutes=15), 0, "CANCEL")]
    ev = spark.createDataFrame([("e", 9, 4)], "id string, capacity int, remaining int")
    after = C.release_cancelled(ev, W.status_transitions(cmds.unionByName(cancels)))
    assert after.first()["remaining"] == 6


def test_late_first_copy_passes_and_drops_are_counted(spark):
    rows = [("a", T0, 0), ("b", T0 + dt.timedelta(days=2), 1), ("b", T0 + dt.timedelta(days=2), 1),
            ("d", T0 + dt.timedelta(days=3), 2), ("c", T0, 3), ("a", T0, 3)]
    src = spark.createDataFrame(rows, "booking_id string, ts timestamp_ntz, _slice int")

    def kept(delay):
        run = SliceReplay(spark, "late-copies")
        run.run(src, "_slice", [0, 1, 2, 3], lambda s: S.dedupe_messages(s, delay=delay).writeStream.format(
            "parquet").option("path", run.sink).outputMode("append"))
        return sorted(r["booking_id"] for r in spark.read.parquet(run.sink).collect()), run.dropped
    assert kept(None) == (["a", "b", "c", "d"], 0)
    names, dropped = kept("15 minutes")
    assert names == ["a", "b", "d"] and dropped == 2


def test_patches_set_updated_at(spark):
    old, new = T0, T0 + dt.timedelta(days=1)
    ev = spark.createDataFrame([("e", "n", 5, 5, 90, old), ("f", "m", 5, 5, 90, old)],
                               "id string, name string, capacity int, remaining int, ticket_price_cents bigint, "
                               "updated_at timestamp_ntz")
    p = spark.createDataFrame([("e", "x", None, None), ("f", None, -1, None)],
                              "id string, name string, capacity int, ticket_price_cents bigint")
    got = {r["id"]: (r["name"], r["updated_at"]) for r in C.patch_events(ev, p, at=F.lit(new)).collect()}
    assert got == {"e": ("x", new), "f": ("m", old)}
    us = spark.createDataFrame([("u", "a", old), ("v", "b", old)], "id string, full_name string, updated_at timestamp_ntz")
    pp = spark.createDataFrame([("u", "u", "Ann"), ("u", "v", "Bob")], "caller_id string, target_id string, full_name string")
    out, _ = C.patch_profiles(us, pp, at=F.lit(new))
    assert {r["id"]: (r["full_name"], r["updated_at"]) for r in out.collect()} == {"u": ("Ann", new), "v": ("b", old)}
