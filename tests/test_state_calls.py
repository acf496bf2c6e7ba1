"""State store calls of the ordered stream rules: a few per shard and
micro-batch, however many rows and keys the shard has there."""

import random
from types import SimpleNamespace

from seatflow.streaming.ordered import AdmitProcessor, InventoryProcessor, RateLimitProcessor, SettleProcessor

MINUTE = 60_000_000


class Store:
    """Counts the calls a processor makes."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _var(self, *_):
        held, store = {}, self

        def put(key, value):
            store.calls += 1
            held[key] = value

        def get(key):
            store.calls += 1
            return held.get(key)

        def drop(key):
            store.calls += 1
            held.pop(key, None)

        return SimpleNamespace(getValue=get, updateValue=put, removeKey=drop, get=lambda: get(0),
                               update=lambda v: put(0, v), clear=lambda: drop(0), held=held)

    getValueState = getMapState = _var

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


def _run(processor, batches, seed):
    """The rows out and the most calls of a micro-batch, one shard fed ``batches`` of (watermark ms, rows)."""
    store, out, most = Store(), [], 0
    processor.init(store)
    if seed:
        processor.handleInitialState((0,), seed, None)
    for watermark, rows in batches:
        store.calls, timers = 0, SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        if rows:
            out += processor.handleInputRows((0,), iter(rows), timers)
        for ms in sorted(t for t in store.timers if t <= watermark):
            store.timers.discard(ms)
            out += processor.handleExpiredTimer((0,), timers, SimpleNamespace(getExpiryTimeInMs=lambda: ms))
        most = max(most, store.calls)
    return out, most


def _batches(rows, rng, last=10**9):
    """Rows of 1,000 minutes, up to 100 minutes late, in four micro-batches and one without rows."""
    dealt = [(r, r[0] + rng.randrange(100) * MINUTE) for r in rows]
    cut = [[r for r, arrival in dealt if arrival // (275 * MINUTE) == k] for k in range(4)]
    for part in cut:
        rng.shuffle(part)
    marks = [0] + [275_000 * 60 * k - 100 * 60_000 for k in (1, 2, 3)]
    return [*zip(marks, cut), (last, [])]


def test_admission_takes_few_state_calls_a_batch():
    rng = random.Random(3)
    rows = [(rng.randrange(1000) * MINUTE, f"r{i:05}", rng.randint(1, 4), f"e{rng.randrange(600)}") for i in range(4000)]
    left = {f"e{k}": 12 for k in range(500)}
    seed = {"seats": [{"event_id": e, "remaining": n} for e, n in left.items()]}
    out, most = _run(AdmitProcessor(span_ms=15 * 60_000), _batches(rows, rng), seed)
    want = {}
    for _, id_, q, e in sorted(rows):
        ok = q <= left.get(e, -1)
        if ok:
            left[e] -= q
        want[id_] = (ok, left.get(e))
    assert {r["id"]: (r["admitted"], r["remaining"]) for r in out} == want and len(out) == 4000
    assert most <= 150  # seven for each of some 1,000 rows before


def test_settling_takes_few_state_calls_a_batch():
    rng = random.Random(4)
    rows = [(rng.randrange(1000) * MINUTE, f"b{i % 3000}", i // 3000, None, rng.random() < .3, f"b{i % 3000}")
            for i in range(4000)]
    seed = {"bookings": [{"booking_id": f"b{i}", "event_id": "e", "quantity": 1, "unit_price_cents": 5, "status": "PENDING"}
                         for i in range(2900)]}
    out, most = _run(SettleProcessor(span_ms=15 * 60_000), _batches(rows, rng), seed)
    want, status = [], {b["booking_id"]: "PENDING" for b in seed["bookings"]}
    for _, b, _, _, fails, _ in sorted(rows, key=lambda r: r[:3]):
        to = "CANCELLED" if fails else "CONFIRMED"
        if b not in status:
            want.append((b, None, None, "UNKNOWN_BOOKING"))
        elif status[b] != to:
            want.append((b, status[b], to, None))
            status[b] = to
    got = [(r["booking_id"], r["from_status"], r["to_status"], r["reason"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str) and most <= 150


def test_inventory_calls_are_one_per_booking_and_a_few_a_batch():
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        us, e = rng.randrange(900) * MINUTE, f"e{i % 200}"
        rows.append((us, f"b{i:04}", 0, 1, "CREATE", e))
        if i % 2:
            rows.append((us + rng.randint(1, 40) * MINUTE, f"b{i:04}", 1, 1, rng.choice(["CONFIRM", "CANCEL"]), e))
    seed = {"seats": [{"event_id": f"e{k}", "remaining": 5, "capacity": 5} for k in range(200)]}
    batches = _batches(rows, rng)
    out, most = _run(InventoryProcessor(span_ms=15 * 60_000, ttl_us=15 * MINUTE), batches, seed)
    again, _ = _run(InventoryProcessor(ttl_us=15 * MINUTE), [(10**9, sorted(rows))], seed)  # at once, narrow buckets
    key = lambda r: (r["event_id"], r["booking_id"], r["seq"], r["command"], r["ts"], r["applied"], r["remaining"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) > len(rows)
    assert most <= 2 * max(len(b) for _, b in batches) + 60


def test_a_client_keeps_its_bucket_while_rows_of_the_slot_wait():
    day = 86_400_000
    p = RateLimitProcessor(4 * 3_600_000_000, 2, width_ms=day)
    hours = [0, 25, 28, 49]  # the bucket of hour 0 is full again at hour 4, that of hour 25 at 29, inside a waiting slot
    rows = [(h * 3_600_000_000, f"q{h}", "c") for h in hours]
    out, _ = _run(p, [(0, rows[:1]), (day, rows[1:3]), (2 * day - 3_600_000, []), (2 * day, rows[3:]),
                      (2 * day + 6 * 3_600_000, []), (9 * day, [])], None)
    assert [(r["request_id"], r["tokens"] // 3_600_000_000) for r in out] == [("q0", 4), ("q25", 4), ("q28", 3), ("q49", 4)]


def test_a_bucket_is_not_dropped_before_the_rows_ahead_of_it():
    day = 86_400_000
    p = RateLimitProcessor(4 * 3_600_000_000, 2, width_ms=day)
    rows = [(23 * 3_600_000_000, "a", "c"), (25 * 3_600_000_000, "b", "c")]  # full at hour 27; b comes at 25
    out, _ = _run(p, [(0, rows), (day, []), (day + 5 * 3_600_000, []), (2 * day, []), (9 * day, [])], None)
    assert [r["tokens"] // 3_600_000_000 for r in out] == [4, 2]
