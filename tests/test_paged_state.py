"""Values in pages and waiting rows in one value: few calls for many bookings, right across growth."""

import random
from types import SimpleNamespace

from seatflow.streaming.ordered import (INLINE_ROWS, PAGE_ROWS, SINGLES, AdmitProcessor, InventoryProcessor, Paged,
                                        SettleProcessor)
from tests.test_state_calls import MINUTE, Store, _batches, _run


def test_pages_hold_what_a_dict_holds_and_grow():
    rng, store, want = random.Random(1), Store(), {}
    for n in (10, SINGLES, 400, 3000, 20, 9000):
        values = Paged(store, "v") if not want else values
        for _ in range(n):
            key = ("e", rng.choice([None, f"b{rng.randrange(6000)}"]))
            assert values.get(key) == want.get(key)
            if rng.random() < .2:
                want.pop(key, None)
                values.update(None, key)
            else:
                want[key] = (rng.randrange(9), None)
                values.update(want[key], key)
        values.close()
        assert all(values.get(key) == value for key, value in want.items()) and values.keys == len(want)
        values.close()
    assert len(want) / PAGE_ROWS <= len(values.pages.held) <= 4 * len(want) / PAGE_ROWS
    before = len(want)
    store.calls = 0
    values.update((1, None), ("e", "new"))  # what one key costs doesn't grow with the keys
    values.close()
    assert before > 2000 and store.calls <= 4


def test_few_keys_lie_alone_and_leave_nothing_behind():
    store = Store()
    values = Paged(store, "v")
    for k in range(SINGLES):
        values.update((k,), f"k{k}")
    values.close()
    assert len(values.pages.held) == SINGLES
    for k in range(SINGLES):
        values.update(None, f"k{k}")
    values.close()
    assert not values.pages.held


def test_bookings_take_far_fewer_calls_than_there_are():
    rng = random.Random(2)
    rows = [(rng.randrange(900) * MINUTE, f"b{i:04}", 0, 1, "CREATE", f"e{i % 200}") for i in range(4000)]
    seed = {"seats": [{"event_id": f"e{k}", "remaining": 50, "capacity": 50} for k in range(200)]}
    out, most = _run(InventoryProcessor(span_ms=15 * 60_000), _batches(rows, rng), seed)
    assert len(out) == 4000 and all(r["applied"] for r in out)
    assert most <= 150  # one for each of some 1,000 bookings before


def test_few_waiting_rows_are_one_value():
    rng = random.Random(3)
    rows = [(rng.randrange(1000) * MINUTE, f"r{i:05}", 1, f"e{rng.randrange(60)}") for i in range(2000)]
    seed = {"seats": [{"event_id": f"e{k}", "remaining": 9, "capacity": 9} for k in range(60)]}
    out, most = _run(AdmitProcessor(span_ms=15 * 60_000), _batches(rows, rng), seed)
    assert len(out) == 2000 and most <= 12  # two or three for each bucket of time before


def test_many_waiting_rows_go_to_parts():
    rows = [(k * MINUTE, f"r{k:05}", 1, "e") for k in range(3 * INLINE_ROWS)]
    random.Random(4).shuffle(rows)
    p, store = AdmitProcessor(span_ms=500 * 60_000), Store()
    p.init(store)
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    p.handleInitialState((0,), {"seats": [{"event_id": "e", "remaining": 10, "capacity": 10}]}, timers)
    assert not list(p.handleInputRows((0,), iter(rows), timers)) and len(p.rows.held) >= 4
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**10)
    out = list(p.handleExpiredTimer((0,), timers, SimpleNamespace(getExpiryTimeInMs=lambda: min(store.timers))))
    assert [r["id"] for r in out] == sorted(r[1] for r in rows) and [r["admitted"] for r in out[:11]] == [True] * 10 + [False]
    assert not p.rows.held


def test_settling_reads_only_the_pages_of_its_bookings():
    seed = {"bookings": [{"booking_id": f"b{i}", "event_id": "e", "quantity": 1, "unit_price_cents": 5, "status": "PENDING"}
                         for i in range(20 * PAGE_ROWS)]}
    out, most = _run(SettleProcessor(), [(0, [(MINUTE, "b7", 0, None, False, "b7")]), (10**9, [])], seed)
    assert [(r["booking_id"], r["to_status"]) for r in out] == [("b7", "CONFIRMED")] and most <= 12
    p, store = SettleProcessor(), Store()
    p.init(store)
    p.handleInitialState((0,), seed, None)
    assert len(p.booking.pages.held) >= 20  # all of a shard's bookings were one value before


def test_state_store_settings(spark):
    from seatflow.streaming.runner import enable_state_store

    enable_state_store(spark)
    assert spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == "3"
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled") == "true"
