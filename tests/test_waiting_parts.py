"""Waiting rows far apart in time (J6_live_counters, F1): few state values, and work that grows with the rows."""

import random
import time
from types import SimpleNamespace

import pytest

from seatflow.streaming import ordered as O
from tests.test_state_calls import MINUTE, Store, _batches, _run

SEATS = {"seats": [{"event_id": f"e{k}", "remaining": 9, "capacity": 9} for k in range(500)]}


def _fed(processor, rows, seed=SEATS):
    """The processor's store after one micro-batch of ``rows`` that all wait, and the calls that took."""
    store = Store()
    processor.init(store)
    processor.handleInitialState((0,), seed, None)
    store.calls = 0
    assert not list(processor.handleInputRows((0,), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    return store, store.calls


def _released(processor, store, watermark):
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    return list(processor.handleExpiredTimer((0,), timers, SimpleNamespace(getExpiryTimeInMs=lambda: min(store.timers))))


def _sparse(n, rng, apart=3):
    """``n`` requests in no order, each in a bucket of its own."""
    rows = [(k * apart * MINUTE, f"r{k:06}", rng.randint(1, 3), f"e{rng.randrange(600)}") for k in range(n)]
    return rng.sample(rows, n)


def _admitted(rows):
    left, want = {s["event_id"]: s["remaining"] for s in SEATS["seats"]}, []
    for _, id_, q, e in sorted(rows):
        ok = e in left and q <= left[e]
        if ok:
            left[e] -= q
        want.append((id_, ok, left.get(e)))
    return want


def test_rows_far_apart_in_time_share_state_values():
    rows = _sparse(3 * O.INLINE_ROWS, random.Random(1))
    p = O.AdmitProcessor()
    store, calls = _fed(p, rows)
    assert calls <= 20  # one for each of 4,000 buckets before
    store.calls = 0
    out = _released(p, store, 10**12)
    assert [(r["id"], r["admitted"], r["remaining"]) for r in out] == _admitted(rows)
    assert store.calls <= 30 and not p.rows.held


def test_release_takes_time_in_proportion_to_the_rows():
    p = O.AdmitProcessor()
    rows = _sparse(30_000, random.Random(2))
    store, _ = _fed(p, rows)
    start = time.process_time()
    out = _released(p, store, 10**12)
    assert time.process_time() - start < 8  # 0.3 s; more than 25 s when each bucket was looked for among all
    assert [(r["id"], r["admitted"], r["remaining"]) for r in out] == _admitted(rows)


def _small(monkeypatch, part, inline, merged, of):
    for name, n in (("PART_ROWS", part), ("INLINE_ROWS", inline), ("MERGED_ROWS", merged), ("MERGED_OF", of)):
        monkeypatch.setattr(O, name, n)


def test_rows_come_out_when_due_from_parts_that_overlap(monkeypatch):
    _small(monkeypatch, 50, 10, 7, 200)
    rng = random.Random(3)
    rows = _sparse(3000, rng)
    p, store = O.AdmitProcessor(span_ms=2 * 60_000), Store()
    p.init(store)
    p.handleInitialState((0,), SEATS, None)
    out, end = [], 9000
    for k in range(60):  # rows up to 1,500 minutes behind the latest
        mark = 150 * k - 1500
        timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: max(0, mark) * 60_000)
        came = [r for r in rows if max(0, (r[0] // MINUTE * 7919) % 1500 + r[0] // MINUTE) // 150 == k]
        before = len(out)
        out += p.handleInputRows((0,), iter(came), timers)
        times = [int(r["id"][1:]) * 3 for r in out[before:]]
        assert times == sorted(times) and all(t < mark for t in times)
        assert len(out) == sum(r[0] // MINUTE + 1 <= mark for r in rows)
        assert min(store.timers) > max(0, mark) * 60_000 and not p.read and not p.ready
    came = [r for r in rows if ((r[0] // MINUTE * 7919) % 1500 + r[0] // MINUTE) // 150 >= 60]
    out += p.handleInputRows((0,), iter(came), SimpleNamespace(getCurrentWatermarkInMs=lambda: (end + 1) * 60_000))
    assert [(r["id"], r["admitted"], r["remaining"]) for r in out] == _admitted(rows)
    assert not p.rows.held


def test_a_large_shard_is_not_read_at_once(monkeypatch):
    _small(monkeypatch, 100, 10, 20, 400)
    p, most = O.AdmitProcessor(), [0]
    rows = _sparse(8000, random.Random(4))
    store, _ = _fed(p, rows)
    real = p._step

    def step(key, some, timers):
        most[0] = max(most[0], len(p.read) + sum(map(len, p.ready.values())) + len(p.new))
        return real(key, some, timers)

    p._step = step
    out = _released(p, store, 10**12)
    assert [(r["id"], r["admitted"], r["remaining"]) for r in out] == _admitted(rows)
    assert most[0] < 800


def test_few_rows_a_batch_do_not_leave_a_part_each(monkeypatch):
    _small(monkeypatch, 1000, 100, 50, 5000)
    p, store = O.AdmitProcessor(), Store()
    p.init(store)
    p.handleInitialState((0,), SEATS, None)
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for row in _sparse(1000, random.Random(5)):
        assert not list(p.handleInputRows((0,), iter([row]), timers))
    assert len(p.rows.held) <= 20 and len(_released(p, store, 10**12)) == 1000


@pytest.mark.parametrize("ttl,keep", [(None, None), (15 * MINUTE, None), (None, 400 * MINUTE)])
def test_inventory_is_the_same_from_small_parts(monkeypatch, ttl, keep):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        us, e = rng.randrange(900) * MINUTE, f"e{i % 150}"
        rows.append((us, f"b{i:04}", 0, 1, "CREATE", e))
        if i % 2:
            rows.append((us + rng.randint(1, 60) * MINUTE, f"b{i:04}", 1, 1, rng.choice(["CONFIRM", "CANCEL"]), e))
    seed = {"seats": [{"event_id": f"e{k}", "remaining": 5, "capacity": 5} for k in range(150)]}

    def decided(span):
        out, _ = _run(O.InventoryProcessor(span_ms=span, ttl_us=ttl, keep_us=keep), _batches(rows, random.Random(7)), seed)
        return sorted((r["event_id"], r["booking_id"], r["seq"], r["command"], r["ts"], r["applied"], r["remaining"]) for r in out)

    whole = decided(900 * 60_000)
    _small(monkeypatch, 60, 10, 8, 100)
    assert decided(60_000) == whole and len(whole) >= len(rows)
