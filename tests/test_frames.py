"""Rows of the ordered streams in frames (F3, F4): nothing is lost or changed on the way."""

from types import SimpleNamespace

import pandas as pd

from seatflow.streaming.operators import _BOOKINGS
from seatflow.streaming.ordered import NO_TIME, PAGE_ROWS, AdmitProcessor, Frames, SettleProcessor
from tests.test_state_calls import MINUTE, Store

FAR = 32_503_680_000_000_000  # the year 3000


def _frame(rows, names):
    return pd.DataFrame(rows, columns=names)


def test_nulls_and_far_times_pass_frames():
    names = ["ts_us", "id", "quantity", "key"]
    p, store = Frames(AdmitProcessor(), "seats", (("event_id", "string"), ("remaining", "int"))), Store()
    p.init(store)
    p.handleInitialState((0,), _frame([("e", 5), ("f", 1)], ["event_id", "remaining"]), None)
    rows = [(2 * MINUTE, "b", 3, "e"), (MINUTE, "a", 2, "e"), (FAR, "far", 1, "f"), (3 * MINUTE, "c", 1, None)]
    tm = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    # a frame with a null has doubles for whole numbers
    early = list(p.handleInputRows((0,), iter([_frame(rows[:2], names), _frame(rows[2:], names), _frame(
        [(NO_TIME, "now", None, "x"), (NO_TIME, "too", 1.0, "x")], names)]), tm))
    assert [(r.id, r.quantity, r.admitted, r.remaining, r.created_at) for f in early for r in f.itertuples()] == [
        ("now", None, False, None, None), ("too", 1, False, None, None)]
    tm = SimpleNamespace(getCurrentWatermarkInMs=lambda: 9_000_000_000_000)  # 2255
    out = pd.concat(p.handleExpiredTimer((0,), tm, SimpleNamespace(getExpiryTimeInMs=lambda: min(store.timers))))
    assert [(r.id, r.admitted, r.remaining) for r in out.itertuples()] == [
        ("a", True, 3), ("b", True, 0), ("c", False, None), ("far", True, 0)]
    assert out["created_at"].iloc[-1].year == 3000 and type(out["quantity"].iloc[0]) is int


def test_a_shards_start_may_come_in_several_frames():
    p, store = Frames(SettleProcessor(), "bookings", _BOOKINGS), Store()
    p.init(store)
    ids = [f"b{i}" for i in range(5 * PAGE_ROWS)]
    names = [n for n, _ in _BOOKINGS]
    for part in (ids[:10], ids[10:900], ids[900:]):
        p.handleInitialState((0,), _frame([(b, "e", None if b == "b3" else 2, 100, "PENDING") for b in part], names), None)
    rows = _frame([(MINUTE, b, 0, None, b == "b5", b) for b in ids], ["ts_us", "booking_id", "seq", "reason", "fails", "key"])
    tm = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9)
    out = pd.concat(p.handleInputRows((0,), iter([rows]), tm))
    assert sorted(out["booking_id"]) == sorted(ids) and out["reason"].isnull().all()
    held = out.set_index("booking_id")
    assert held.loc["b3", "quantity"] is None and held.loc["b7", "quantity"] == 2
    assert held.loc["b5", "to_status"] == "CANCELLED" and held.loc["b1200", "to_status"] == "CONFIRMED"
