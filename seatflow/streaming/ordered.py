"""Keyed rules on a stream whose rows come out of order (T1 in full, T2 with T7, T3, T4, T7).

Rows wait in state and are handed to the rule in event-time order, key by key,
as the watermark passes them.  A call to the state store costs far more than a
row does, so the keys (events, bookings, clients) are dealt by hash into a fixed
number of shards, and the shard is what Spark groups by: a shard's few values
are one state value, many values lie in pages by the hash of their key, and its
waiting rows are one value as long as they are few.  Where they are more, the
later ones go to values of their own, in parts by event time: a bucket of time,
or as many neighbouring ones as make up enough rows.  Rows that the watermark
has passed when they come are never stored.  So a shard costs a few calls per
micro-batch, however many rows, keys and moments it has there.  Pages and
waiting rows are pickled here: Spark takes many times as long for typed rows.

A row is released when the watermark has passed its slot of ``width_ms``.  One
timer per shard, at the first such moment, wakes shards that get no more rows.
What is in memory at once are the rows of one shard up to the next part not read
yet; what is sorted, one bucket of them.  Rows behind the watermark are refused by Spark before they come here and
counted in the query's progress (``runner.ProgressLog``).

A rule may also put rows of its own into the order, after the row at hand: the
cancel of a booking that is never settled, or the order to forget one.

A row without a time has no place in the order; the rule gets it on arrival.

Spark hands rows over in frames (``Frames``): converting them one by one, in and
out, takes longer than all the rest.
"""

from __future__ import annotations

import heapq
import pickle
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from itertools import islice
from operator import itemgetter
from zlib import crc32

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle,
                                                      TimerValues)

from seatflow.schemas import CANCELLED, CONFIRMED

WIDTH_MS = 60_000
SHARDS = 1024  # fixed for the life of a checkpoint
PART_ROWS = 20_000  # of a shard's rows in Python before they go to state, and of parts read at once
INLINE_ROWS = 2_000  # of a shard's waiting rows that lie in one value
MERGED_ROWS = 1_000  # of a part that takes in neighbouring buckets
MERGED_OF = 100_000  # of a shard's rows in parts, beyond which new parts take in fewer: those about one moment meet in memory
PAGE_ROWS = 256  # of a page, on average
PAGED_ROWS = 100_000  # of a shard's pages in Python before they go to state
SINGLES = 48  # values of a shard that lie alone
ALONE = 1 << 31  # pages of a shard with no more values than that
FRAME_ROWS = 10_000  # of a frame handed back
NO_TIME = -(1 << 63)  # in ``ts_us`` of a frame; a column with nulls would be one of doubles
FIRST_TIME, LAST_TIME = "1700-01-01", "2262-01-01"  # event times of frames are nanoseconds
# rows after this wait for no later time, as the watermark may not get there
LAST_US = 7_258_118_400_000_000  # 2200-01-01
_EPOCH = datetime(1970, 1, 1)
_time = itemgetter(0)  # of a row


def at(us: int | None) -> datetime | None:
    return None if us is None else _EPOCH + timedelta(microseconds=us)


def _turn(row: tuple) -> list:
    return [(x is not None, x) for x in row[:3]]


class PerKey:
    """One value per key, all of a shard as one state value that is read when
    first asked for and written back once, if it changed.  ``key`` is the key
    at hand."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key_name: str, schema: str):
        # by column: Spark converts an array of structs struct by struct
        fields = [f"{key_name}: string", *schema.split(", ")]
        self.state = handle.getValueState(name, ", ".join(f"{f.split(':')[0]} array<{f.split(':')[1].strip()}>" for f in fields))
        self.key, self.read, self.changed = None, None, False

    def all(self) -> dict:
        if self.read is None:
            held = self.state.get()
            self.read = {v[0]: v[1:] for v in zip(*held)} if held else {}
        return self.read

    def get(self) -> tuple | None:
        return self.all().get(self.key)

    def update(self, value: tuple) -> None:
        self.all()[self.key], self.changed = value, True

    def keep(self, wanted) -> None:
        """Drop the values that are not ``wanted``."""
        kept = {key: value for key, value in self.all().items() if wanted(value)}
        self.changed |= len(kept) < len(self.read)
        self.read = kept

    def _write(self, values: list[tuple]) -> None:
        self.state.update(tuple(list(column) for column in zip(*values)))

    def seed(self, values: list[tuple]) -> None:
        """Values to start from; those of a shard may come in several calls."""
        self.all().update((v[0], v[1:]) for v in values)
        self.changed = True
        self.close()

    def close(self) -> None:
        if self.changed and self.read:
            self._write([(key, *value) for key, value in self.read.items()])
        elif self.changed:
            self.state.clear()
        self.read, self.changed = None, False


class Paged:
    """One value per key, for many keys: they are dealt by hash into pages, each
    one state value, that are read when first asked for and written back once,
    if they changed.  The pages of a shard, a power of two, are doubled when
    they hold more than ``PAGE_ROWS`` on average, so what a key costs doesn't
    grow with the keys held.  In a shard with few keys every value lies alone.
    ``key`` is the key at hand."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.pages = handle.getMapState(name, "page int", "held binary")
        self.size = handle.getValueState(f"{name}_size", "pages long, keys long, singles array<int>")
        self.key, self.n = None, None
        self.read: dict[int, dict] = {}
        self.dirty: set[int] = set()
        self.in_read = 0

    def _sized(self) -> int:
        if self.n is None:
            self.n, self.keys, singles = self.size.get() or (ALONE, 0, [])
            self.singles = set(singles)
            self.was = self.n, self.keys, set(singles)
        return self.n

    def _load(self, page: int) -> dict:
        if self.n == ALONE and page not in self.singles:
            return {}
        held = self.pages.getValue((page,))
        return pickle.loads(held[0]) if held else {}

    def _save(self, page: int, values: dict) -> None:
        if self.n == ALONE:
            (self.singles.add if values else self.singles.discard)(page)
        if values:
            self.pages.updateValue((page,), (pickle.dumps(values, 5),))
        else:
            self.pages.removeKey((page,))

    def _page(self, key) -> int:
        return crc32(repr(key).encode()) & (self._sized() - 1)

    def _open(self, page: int) -> dict:
        values = self.read.get(page)
        if values is None:
            if self.in_read > PAGED_ROWS:
                self._flush()
            values = self.read[page] = self._load(page)
            self.in_read += len(values)
        return values

    def get(self, key=None) -> tuple | None:
        key = self.key if key is None else key
        return self._open(self._page(key)).get(key)

    def update(self, value: tuple | None, key=None) -> None:
        """``value`` of a key, None to drop it."""
        key = self.key if key is None else key
        page = self._page(key)
        values = self._open(page)
        if value is None:
            if key not in values:
                return
            del values[key]
            self.keys -= 1
        else:
            new = key not in values
            self.keys += new
            self.in_read += new
            values[key] = value
        self.dirty.add(page)

    def seed(self, values: list[tuple]) -> None:
        """Values to start from; those of a shard may come in several calls."""
        held = {key: value for key, *value in values}
        self._sized()
        if self.keys:
            for key, value in held.items():
                self.update(tuple(value), key)
            return self.close()
        self.keys = len(held)
        if self.keys > SINGLES:
            self.n = 1 << max(0, (self.keys // PAGE_ROWS).bit_length())
        for key, value in held.items():
            page = self._page(key)
            self.read.setdefault(page, {})[key] = tuple(value)
            self.dirty.add(page)
        self.close()

    def _flush(self) -> None:
        for page in self.dirty:
            self._save(page, self.read[page])
        self.read, self.dirty, self.in_read = {}, set(), 0

    def close(self) -> None:
        if self.n is None:
            return
        if self.n == ALONE and self.keys > SINGLES:
            alone = [self._open(page) for page in self.singles | self.dirty]
            for page in self.singles:
                self.pages.removeKey((page,))
            self.n, self.singles = 1, set()
            self.read, self.dirty = {0: {key: value for held in alone for key, value in held.items()}}, {0}
        self._flush()
        while self.keys > self.n * PAGE_ROWS:
            self.n *= 2  # page by page: a key stays or goes to the page that far behind
            for page in range(self.n // 2):
                values = self._load(page)
                gone = {key: value for key, value in values.items() if self._page(key) != page}
                if gone:
                    self._save(page, {key: value for key, value in values.items() if key not in gone})
                    self._save(page + self.n // 2, gone)
        if (self.n, self.keys, self.singles) != self.was:
            self.size.update((self.n, self.keys, sorted(self.singles)))
        self.n = None


class InOrder(StatefulProcessor):
    """``fields`` (name, type) name a row's columns in the order rows are
    sorted by, the first ``ts_us``; the input has them first, then ``key``.
    ``step`` gets a key and its released rows as tuples of the fields.
    ``values`` is the rule's value of the key at hand.  ``span_ms`` is the
    width of a stored bucket."""

    fields: tuple[tuple[str, str], ...]
    values: PerKey | Paged

    def __init__(self, width_ms: int = WIDTH_MS, span_ms: int = 0):
        self.width, self.span = width_ms, max(width_ms, span_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "bucket long, part int", "rows binary")
        # the parts and the rows outside them; the shard's timer
        self.index = handle.getValueState("index", "waiting binary, timer long")

    # ------------------------------------------------ what a rule says
    def step(self, key: tuple, rows: list[tuple], timers: TimerValues) -> Iterator[Row]:
        raise NotImplementedError

    def leave(self) -> int | None:
        """After a shard's rows: a time to be woken at, if any."""

    # ------------------------------------------------ waiting rows
    def due(self, us: int) -> int:
        return (min(us, LAST_US) // (1000 * self.width) + 1) * self.width

    def _before(self, ms: int) -> int:
        """The time before which rows are due by ``ms``."""
        us = ms // self.width * self.width * 1000
        return us if us <= LAST_US else 1 << 63

    def _bucket(self, row: tuple) -> int:
        return self.due(row[0]) // self.span

    def add(self, row: tuple) -> None:
        """Put ``row`` in its place in the order."""
        if row[0] >= self.cut:
            (self.new if row[0] >= self.limit else self.read).append(row)
            return
        bucket = self._bucket(row)
        if bucket in self.ready:
            self.ready[bucket].append(row)
        else:
            self.ready[bucket] = [row]
            heapq.heappush(self.next, bucket)

    def _store(self, inline: int = 0) -> None:
        """Put waiting rows into parts if they are more than ``inline``, all but the first half of that."""
        if len(self.new) <= inline:
            return
        self.new.sort(key=_time)
        rows, self.new = self.new[inline // 2:], self.new[:inline // 2]
        least, start = max(1, MERGED_ROWS * MERGED_OF // max(MERGED_OF, self.stored)), 0
        while start < len(rows):
            end = start + least if len(rows) - start >= 2 * least else len(rows)
            end = bisect_right(rows, self._bucket(rows[end - 1]), end, key=self._bucket)
            part = self._bucket(rows[start]), self.number
            self.rows.updateValue(part, (pickle.dumps(rows[start:end], 5),))
            self.parts[part] = self.due(rows[start][0]), end - start
            self.number, self.stored, start = self.number + 1, self.stored + end - start, end

    def _take(self, part: tuple[int, int]) -> list[tuple]:
        self.stored -= self.parts.pop(part)[1]
        rows = pickle.loads(self.rows.getValue(part)[0])
        self.rows.removeKey(part)
        return rows

    def _begin(self, timers: TimerValues) -> None:
        self.watermark = timers.getCurrentWatermarkInMs()
        held = self.index.get()
        self.held = (bytes(held[0]), held[1]) if held else (None, None)
        self.open = None
        # rows before the limit are due; those before the cut are released at the moment, by bucket
        # (``next`` is a heap of these), the others are ``read`` and wait for the parts about them
        self.limit, self.cut, self.read, self.ready, self.next = NO_TIME, NO_TIME, [], {}, []
        self.parts: dict[tuple[int, int], tuple[int, int]]  # by bucket and number: due of the first row, rows
        self.new: list[tuple]
        self.parts, self.new = pickle.loads(self.held[0]) if held else ({}, [])
        self.number = max((n for _, n in self.parts), default=-1) + 1
        self.stored = sum(n for _, n in self.parts.values())

    def _step(self, key, rows: list[tuple], timers: TimerValues) -> Iterator[Row]:
        self.values.key = key
        yield from self.step((key,), rows, timers)

    def _release(self, timers: TimerValues) -> Iterator[Row]:
        parts = sorted((part for part, (first, _) in self.parts.items() if first <= self.watermark), reverse=True)
        self.limit = self._before(self.watermark)
        self.read, self.new = self.new, []
        while True:
            last = None
            end = len(self.read) + PART_ROWS
            while parts and (len(self.read) < end or parts[-1][0] == last):
                last = parts[-1][0]
                self.read += self._take(parts.pop())
            self.cut = min(self.limit, self._before(parts[-1][0] * self.span - 1)) if parts else self.limit
            rows, self.read = self.read, []
            for row in rows:
                self.add(row)
            while self.next:
                self.open = heapq.heappop(self.next)
                of: dict = {}
                for row in self.ready.pop(self.open):
                    of.setdefault(row[-1], []).append(row[:-1])
                for key, rows in of.items():
                    if len(rows) > 1:
                        rows.sort(key=_turn)
                    yield from self._step(key, rows, timers)
            if len(self.new) > PART_ROWS:
                self._store()
            if not parts:
                break
        self.limit, self.cut, self.open = NO_TIME, NO_TIME, None

    def _end(self, fired: int | None = None) -> None:
        self._store(INLINE_ROWS)
        wake = [first for first, _ in self.parts.values()]
        if self.new:
            wake.append(self.due(min(map(_time, self.new))))
        if (own := self.leave()) is not None:
            wake.append(own)
        self.values.close()
        waiting = pickle.dumps((self.parts, self.new), 5)
        self.parts, self.new = {}, []
        timer = min(wake, default=None)
        old = self.held[1]
        if timer != old:
            if old is not None and old != fired:  # one that fires is taken away by Spark
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        if timer is None:
            if old is not None:
                self.index.clear()
        elif (waiting, timer) != self.held:
            self.index.update((waiting, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self._begin(timerValues)
        n, width = 0, len(self.fields) + 1
        for r in rows:
            row = tuple(r)[:width]
            if row[0] is None:
                yield from self._step(row[-1], [row[:-1]], timerValues)
                continue
            self.add(row)
            n += 1
            if n % PART_ROWS == 0:
                self._store()
        yield from self._release(timerValues)
        self._end()

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self._begin(timerValues)
        yield from self._release(timerValues)
        self._end(expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _values(frame: pd.DataFrame, name: str, kind: str) -> list:
    """A column's Python values, None where it has none."""
    column = frame[name]
    if name == "ts_us":
        return [None if v == NO_TIME else v for v in column.tolist()]
    if column.dtype.kind in "ib":
        return column.tolist()
    whole = kind in ("int", "bigint")
    return [None if v is None or v != v else int(v) if whole else v for v in column.tolist()]


class Frames(StatefulProcessor):
    """A rule whose rows come and go in frames, as do the values it starts from:
    ``seeds`` (name, type) are their columns, ``start`` is the rule's name for them."""

    def __init__(self, rule: InOrder, start: str = "", seeds: tuple[tuple[str, str], ...] = ()):
        self.rule, self.start, self.seeds = rule, start, seeds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rule.init(handle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        names = [name for name, _ in self.seeds]
        columns = [_values(initialState, *seed) for seed in self.seeds]
        self.rule.handleInitialState(key, {self.start: [dict(zip(names, row)) for row in zip(*columns)]}, timerValues)

    def _frames(self, rows: Iterator[Row]) -> Iterator[pd.DataFrame]:
        while some := list(islice(rows, FRAME_ROWS)):
            yield pd.DataFrame([tuple(r) for r in some], columns=some[0].__fields__, dtype=object)

    def _rows(self, frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            yield from zip(*(_values(frame, name, kind) for name, kind in (*self.rule.fields, ("key", "string"))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield from self._frames(self.rule.handleInputRows(key, self._rows(rows), timerValues))

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frames(self.rule.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def close(self) -> None:
        self.rule.close()


class AdmitProcessor(InOrder):
    """Admission (T3): one value per event, the seats left.  A refused request
    takes nothing and a later smaller one may still fit."""

    fields = (("ts_us", "bigint"), ("id", "string"), ("quantity", "int"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.values = self.seats = PerKey(handle, "seats", "event_id", "remaining: int")

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        self.seats.seed([(r["event_id"], int(r["remaining"])) for r in initialState["seats"]])

    def step(self, key: tuple, rows: list[tuple], timers: TimerValues) -> Iterator[Row]:
        seats = self.seats.get()
        known = seats is not None
        start = rem = seats[0] if known else 0
        for us, id_, q in rows:
            ok = known and q <= rem
            if ok:
                rem -= q
            yield Row(id=id_, event_id=key[0], quantity=q, created_at=at(us), admitted=ok,
                      remaining=rem if known else None)
        if rem != start:
            self.seats.update((rem,))


class InventoryProcessor(InOrder):
    """Seats of one event (T3 + T7): CREATE takes them if they fit, CANCEL of a
    holding booking gives them back (at most capacity), CONFIRM after CANCEL
    holds again without taking seats.

    State: remaining and capacity per event, and per booking its seats, whether it holds
    them, whether it was ever settled, and its last effective command.  With
    ``ttl_us`` a booking that is neither confirmed nor cancelled within it is
    cancelled at that moment (T2), live, with the seats given back before any
    later row is decided; a settlement at exactly the deadline is in time.
    With ``keep_us`` a booking is forgotten that long after its last effective
    command; later commands of it change nothing, whether or not its state is
    still there, so the result does not depend on when the state goes.
    """

    fields = (("ts_us", "bigint"), ("booking_id", "string"), ("seq", "int"), ("quantity", "int"), ("command", "string"))

    def __init__(self, width_ms: int = WIDTH_MS, span_ms: int = 0, ttl_us: int | None = None, keep_us: int | None = None):
        super().__init__(width_ms, span_ms)
        if ttl_us is not None and ttl_us < width_ms * 1000:
            raise ValueError("slots must be shorter than the time to pay")
        self.ttl, self.keep = ttl_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.values = self.seats = PerKey(handle, "seats", "event_id", "remaining: int, capacity: int")
        # by (event, booking): quantity, held, settled, time of the last effective command
        self.bookings = Paged(handle, "bookings")

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        self.seats.seed([(r["event_id"], int(r["remaining"]), int(r["capacity"])) for r in initialState["seats"]])

    def leave(self) -> None:
        self.bookings.close()

    def step(self, key: tuple, rows: list[tuple], timers: TimerValues) -> Iterator[Row]:
        start = self.seats.get()
        known = start is not None
        rem, cap = start = start if known else (0, 0)
        own: list = []  # rows that the rule put into this bucket

        def later(row: tuple) -> None:
            if row[0] < self.cut and self._bucket(row) == self.open:
                heapq.heappush(own, (_turn(row), row))
            else:
                self.add((*row, *key))

        def put(bid, value: tuple) -> None:
            self.bookings.update(value, (*key, bid))
            if self.keep is not None and value[3] is not None:
                gone = value[3] + self.keep
                later((gone, bid, 1 << 30, 0, "FORGET"))

        i = 0
        while own or i < len(rows):
            if own and (i == len(rows) or own[0][0] < _turn(rows[i])):
                us, bid, seq, q, cm = heapq.heappop(own)[1]
            else:
                us, bid, seq, q, cm = rows[i]
                i += 1
            ok = False
            if cm == "CREATE":
                if known and q <= rem:
                    rem, ok = rem - q, True
                    put(bid, (q, True, False, us))
                    if self.ttl is not None and us is not None:
                        later((us + self.ttl, bid, 0, q, "EXPIRE"))
            else:
                b = self.bookings.get((*key, bid))
                gone = b is None or (None not in (self.keep, us, b[3]) and us > b[3] + self.keep)
                if cm == "FORGET":
                    if b is not None and us >= b[3] + self.keep:
                        self.bookings.update(None, (*key, bid))
                    continue
                if cm == "EXPIRE":
                    now = [r[4] for r in rows[i:i + 8] if r[:2] == (us, bid)]  # settled at this very moment
                    if gone or b[2] or "CONFIRM" in now or "CANCEL" in now:
                        continue
                    cm = "CANCEL"
                if not gone:
                    q = b[0] if b[0] is not None else q
                    if cm == "CANCEL" and b[1]:
                        rem, ok = min(rem + q, cap), True
                        put(bid, (q, False, True, us))
                    elif cm == "CONFIRM" and not b[1]:
                        ok = True
                        put(bid, (q, True, True, us))
                    elif not b[2]:  # confirmed as it was held: settled, nothing else changes
                        self.bookings.update((b[0], b[1], True, b[3]), (*key, bid))
            yield Row(event_id=key[0], booking_id=bid, seq=seq, command=cm, ts=at(us), applied=ok,
                      remaining=rem if known else None)
        if (rem, cap) != start:
            self.seats.update((rem, cap))


class SettleProcessor(InOrder):
    """Status of one booking (T1): a message confirms it, or cancels it where
    the confirmation fails; the status it has already changes nothing."""

    fields = (("ts_us", "bigint"), ("booking_id", "string"), ("seq", "int"), ("reason", "string"), ("fails", "boolean"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.values = self.booking = Paged(handle, "bookings")  # event, quantity, price in cents, status

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        self.booking.seed([tuple(b.values()) for b in initialState["bookings"]])

    def step(self, key: tuple, rows: list[tuple], timers: TimerValues) -> Iterator[Row]:
        held = self.booking.get() if any(r[3] is None for r in rows) else None  # a refused message goes with no booking
        start = event, quantity, price, status = held or (None, None, None, None)
        for us, bid, _, reason, fails in rows:
            if reason is None and held is None:
                reason = "UNKNOWN_BOOKING"
            target = CANCELLED if fails else CONFIRMED
            if reason is None and target == status:
                continue
            yield Row(booking_id=bid, event_id=event, quantity=quantity, unit_price_cents=price,
                      from_status=None if reason else status, to_status=None if reason else target, ts=at(us),
                      reason=reason)
            if reason is None:
                status = target
        if held and status != start[3]:
            self.booking.update((event, quantity, price, status))


class RateLimitProcessor(InOrder):
    """Token bucket of one client (T4) in whole token-microseconds.  The bucket
    is dropped at the moment it would be full again, since a missing
    bucket starts full: state lives only while it matters."""

    fields = (("ts_us", "bigint"), ("request_id", "string"))

    def __init__(self, token_us: int, burst: int, width_ms: int = WIDTH_MS, span_ms: int = 0):
        super().__init__(width_ms, span_ms)
        self.token_us, self.full = token_us, token_us * burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.values = self.bucket = PerKey(handle, "buckets", "client", "tokens: long, last_us: long, refill_ms: long")

    def leave(self) -> int | None:
        # rows of a slot that the watermark has not wholly passed still wait
        self.bucket.keep(lambda held: -(-held[2] // self.width) * self.width > self.watermark)
        return min((-(-held[2] // self.width) * self.width for held in self.bucket.all().values()), default=None)

    def step(self, key: tuple, rows: list[tuple], timers: TimerValues) -> Iterator[Row]:
        tok, last, _ = self.bucket.get() or (self.full, None, 0)
        changed = False
        for us, request in rows:
            if us is None:  # no time: refused, as in W7
                yield Row(key=key[0], request_id=request, ts=None, allowed=False, tokens=None)
                continue
            # a row older than the last one would earn nothing and turn no clock back
            tok = self.full if last is None else min(self.full, tok + max(0, us - last))
            last, changed = us if last is None else max(last, us), True
            ok = tok >= self.token_us
            if ok:
                tok -= self.token_us
            yield Row(key=key[0], request_id=request, ts=at(us), allowed=ok, tokens=tok)
        if changed:
            self.bucket.update((tok, last, -(-(last + self.full - tok) // 1000)))
