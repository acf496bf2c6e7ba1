"""What J1 and C1 store on their way: no column twice, no row without need."""

from datetime import datetime

from seatflow.operators import changes as C
from seatflow.operators import joins as J

T0 = datetime(2024, 1, 1)
ASK = "id string, user_id string, event_id string, quantity int, created_at timestamp_ntz"


def _tables(spark):
    asks = spark.createDataFrame([("a", "u", "e", 1, T0), ("b", "u", "e", 99, T0), ("c", "", "e", 1, T0)], ASK)
    prices = spark.createDataFrame([("e", datetime(2023, 1, 1), 500)],
                                   "event_id string, valid_from timestamp_ntz, ticket_price_cents long")
    return asks, prices, spark.createDataFrame([("e", 9, 9)], "id string, capacity int, remaining int")


def test_j1_carries_event_and_time_once(spark, monkeypatch):
    seen, real = [], J.ranged
    monkeypatch.setattr(J, "ranged", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    asks, prices, _ = _tables(spark)
    out = J.capture_price(asks, prices)
    assert out.columns == [*asks.columns, "unit_price_cents"] and {r["unit_price_cents"] for r in out.collect()} == {500}
    assert not {"event_id", "created_at"} & set(seen[0].schema["_row"].dataType.names)
    assert seen[0].where("_kind = 1 AND _tie IS NOT NULL").count() == 0


def test_c1_stores_only_the_requests_it_goes_on_with(spark, monkeypatch):
    stored, real = {}, C.reliable_checkpoint
    monkeypatch.setattr(C, "reliable_checkpoint", lambda df, name: stored.setdefault(name, real(df, name)))
    asks, prices, events = _tables(spark)
    batch = C.book_batch(asks, events, prices, id_format=None)
    assert [r["id"] for r in stored["booking-requests"].collect()] == ["a"]
    assert sorted(r["id"] for r in batch.refusals.collect()) == ["b", "c"]
    assert batch.events.first()["remaining"] == 8
