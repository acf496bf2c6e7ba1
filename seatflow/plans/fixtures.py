"""Reservation-shaped views over the driver's TPC-H-like tables.

The driver tables hold no users, ticketed events or bookings, so they are
derived here by fixed rules (FIXTURES.md §4); ``seatflow.plans.oracle_views``
states the same rules as DuckDB text.  Joins run on the numeric keys before
ids become strings, and filters stay on raw columns so they reach the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.session import apply_runtime_conf


def _minutes(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), c.cast("int"), F.lit(0))


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _message(booking_id: Column, user_id: Column, event_id: Column, quantity: Column) -> Column:
    return F.concat(F.lit('{"booking_id":"'), booking_id, F.lit('","user_id":"'), user_id,
                    F.lit('","event_id":"'), event_id, F.lit('","quantity":'), _s(quantity), F.lit("}"))


class Fixtures:
    """Lazy DataFrames for every ``v_*`` view at one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_runtime_conf(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- users / events / prices -------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            _s(k).alias("id"),
            F.concat(F.lit("user"), _s(k), F.lit("@example.com")).alias("email"),
            F.when(k % 50 == 0, F.lit("ADMIN")).otherwise(F.lit("USER")).alias("role"),
            F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("full_name"),
        )

    def _event_cols(self, k: Column) -> list[Column]:
        start = _minutes(k * 1013 % 1576800)
        return [
            _s(k).alias("id"),
            F.concat(F.col("p_name"), F.lit(" #"), _s(k)).alias("name"),
            F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("description"),
            (_ntz("1998-01-01 00:00:00") + start).alias("starts_at"),
            (_ntz("1998-01-01 02:00:00") + start).alias("ends_at"),
            F.col("p_size").cast("int").alias("capacity"),
            F.round(F.col("p_retailprice") * 100).cast("bigint").alias("ticket_price_cents"),
        ]

    @cached_property
    def events(self) -> DataFrame:
        return self.table("part").select(*self._event_cols(F.col("p_partkey")))

    @cached_property
    def events_stocked(self) -> DataFrame:
        """``events`` with ``remaining`` = capacity, the start state of every test."""
        return self.events.withColumn("remaining", F.col("capacity"))

    @cached_property
    def prices(self) -> DataFrame:
        e = self.events
        first = e.select(F.col("id").alias("event_id"), _ntz("1900-01-01 00:00:00").alias("valid_from"),
                         "ticket_price_cents")
        later = e.select(F.col("id").alias("event_id"), _ntz("1998-07-01 00:00:00").alias("valid_from"),
                         (F.col("ticket_price_cents") + 100 * (F.col("id").cast("bigint") % 7))
                         .alias("ticket_price_cents"))
        return first.unionByName(later)

    @cached_property
    def new_events(self) -> DataFrame:
        """Event creation requests derived from ``part`` (ids ``new-<k>``):
        some without a name, some with capacity <= 0, some free, some without
        a price; the input of P9 and C4."""
        k = F.col("p_partkey")
        cols = self._event_cols(k)
        return self.table("part").select(
            F.concat(F.lit("new-"), _s(k)).alias("id"),
            F.when(k % 13 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
            cols[2], cols[3], cols[4],
            (F.col("p_size") - 5).cast("int").alias("capacity"),
            F.when(k % 7 == 0, F.lit(0).cast("bigint")).when(k % 11 == 0, F.lit(None).cast("bigint"))
             .otherwise(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("ticket_price_cents"))

    # ---- requests / bookings / commands --------------------------------
    def _request_base(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                           "l_quantity", "l_shipdate")
        od = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        return li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))

    def _request_cols(self) -> list[Column]:
        ok, ln, pk, sk = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
        return [
            F.concat_ws("-", _s(ok), _s(ln), _s(pk), _s(sk),
                        F.date_format("l_shipdate", "yyyyMMdd")).alias("id"),
            _s("o_custkey").alias("user_id"),
            _s(pk).alias("event_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            (F.col("o_orderdate") + _minutes((ok * 7 + ln * 131 + sk * 17) % 1440)).alias("created_at"),
            (sk % 30 + 1).cast("int").alias("delay_minutes"),
            F.col("o_orderstatus"),
        ]

    @cached_property
    def requests(self) -> DataFrame:
        return self._request_base().select(*self._request_cols())

    @cached_property
    def bookings(self) -> DataFrame:
        base = (self._request_base()
                .where((F.col("l_quantity") >= 1) & (F.col("l_quantity") <= 10))
                .join(self.table("part").select("p_partkey", "p_retailprice"),
                      F.col("l_partkey") == F.col("p_partkey")))
        r = base.select(*self._request_cols(),
                        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("unit_price_cents"))
        st = F.col("o_orderstatus")
        return r.select(
            "id", "user_id", "event_id", "quantity", "unit_price_cents",
            F.when(st == "F", F.lit("CONFIRMED")).when(st == "P", F.lit("CANCELLED"))
             .otherwise(F.lit("PENDING")).alias("status"),
            "created_at",
            F.when(st == "O", F.col("created_at"))
             .otherwise(F.col("created_at") + _minutes(F.col("delay_minutes"))).alias("updated_at"),
        )

    @cached_property
    def commands(self) -> DataFrame:
        """``v_commands`` from one pass over ``bookings``: each booking's
        commands are built as an array and exploded (no re-scan per part)."""
        b = self.bookings
        settled = F.col("status") != "PENDING"
        same = F.when(F.col("status") == "CONFIRMED", F.lit("CONFIRM")).otherwise(F.lit("CANCEL"))
        flip = F.when(F.col("status") == "CONFIRMED", F.lit("CANCEL")).otherwise(F.lit("CONFIRM"))
        uid = F.col("user_id").cast("bigint")

        def cmd(ts, seq, command):
            return F.struct(ts.alias("ts"), F.lit(seq).alias("seq"), command.alias("command"))

        cmds = F.array(
            cmd(F.col("created_at"), 0, F.lit("CREATE")),
            F.when(settled, cmd(F.col("updated_at"), 1, same)),
            F.when(settled & (uid % 5 == 0), cmd(F.col("updated_at") + _minutes(F.lit(1)), 2, same)),
            F.when(settled & (uid % 13 == 0), cmd(F.col("updated_at") + _minutes(F.lit(2)), 3, flip)))
        return (b.select(F.col("id").alias("booking_id"), "event_id", "quantity",
                         F.explode(F.array_compact(cmds)).alias("c"))
                .select("booking_id", "event_id", "quantity", "c.ts", "c.seq", "c.command"))

    @cached_property
    def natural_key_rows(self) -> DataFrame:
        """Rows naming their user by e-mail and their event by name (the seed
        loader's form), some naming no one; the input of J2."""
        # hashed, not sorted: the requests stream past the events of their partition
        e = self.events.select(F.col("id").alias("_eid"), "name").hint("shuffle_hash")
        r = self.requests.join(e, F.col("event_id") == F.col("_eid"))
        return r.select(
            F.col("id").alias("request_id"),
            F.concat(F.when(F.col("user_id").cast("bigint") % 9 == 0, F.lit("nobody")).otherwise(F.lit("user")),
                     F.col("user_id"), F.lit("@example.com")).alias("email"),
            F.when(F.col("event_id").cast("bigint") % 10 == 0, F.concat(F.col("name"), F.lit(" (gone)")))
             .otherwise(F.col("name")).alias("event_name"))

    # ---- messages / access log --------------------------------------------
    @cached_property
    def messages(self) -> DataFrame:
        ev = self.table("events")
        k = F.col("event_id")
        return ev.select(
            k.alias("offset_id"), "ts",
            F.when(k % 97 == 0, F.lit("invalid json"))
             .otherwise(_message(_s(k), _s("user_id"), _s(k % 20), k % 12)).alias("body"))

    @cached_property
    def access(self) -> DataFrame:
        ev = self.table("events")
        t, k = F.col("event_type"), F.col("event_id")
        return ev.select(
            _s(k).alias("request_id"), "ts",
            F.when(t.isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
            F.when(t == "purchase", F.lit("/api/v1/bookings"))
             .when(t == "signup", F.lit("/api/v1/users/register"))
             .when(t == "view", F.lit("/api/v1/events"))
             .otherwise(F.lit("/api/v1/events/:id")).alias("path"),
            F.when(t == "error", 500).when(k % 17 == 0, 404).when(k % 19 == 0, 409)
             .otherwise(200).cast("int").alias("status"),
            F.col("value").alias("latency_ms"),
            F.concat(F.lit("10.0.0."), _s("user_id")).alias("client_ip"),
            F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(_s("user_id")).alias("user_id"),
        )

    @cached_property
    def access_lines(self) -> DataFrame:
        """``access`` written as the request logger's JSON lines (level chosen
        as the logger chooses it), the input of S5."""
        a = self.access
        st = F.col("status")
        level = F.when(st >= 500, F.lit("error")).when(st >= 400, F.lit("warn")).otherwise(F.lit("info"))
        line = F.to_json(F.struct(
            level.alias("level"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
            F.lit("Request completed").alias("msg"), F.lit("access").alias("log_type"),
            "request_id", "method", "path", "status", F.col("latency_ms").alias("latency"),
            "client_ip", F.lit("Go-http-client/1.1").alias("user_agent"), "user_id"))
        return a.select(line.alias("value"))

    @cached_property
    def booking_messages(self) -> DataFrame:
        """``v_booking_messages`` from one pass over ``bookings`` (first copy
        and redelivered copy exploded from an array)."""
        b = self.bookings
        uid = F.col("user_id").cast("bigint")
        body = _message(F.col("id"), F.col("user_id"), F.col("event_id"), F.col("quantity"))
        first = F.when(uid % 7 != 0, F.struct(
            F.col("created_at").alias("ts"), F.lit(0).alias("copy"),
            F.when(uid % 97 == 3, F.lit("invalid json")).otherwise(body).alias("body")))
        again = F.when(uid % 5 == 1, F.struct(
            (F.col("created_at") + _minutes(F.lit(1))).alias("ts"), F.lit(1).alias("copy"), body.alias("body")))
        return (b.select(F.explode(F.array_compact(F.array(first, again))).alias("m"))
                .select("m.ts", "m.copy", "m.body"))

    def with_uuid(self, df: DataFrame, col: str, version: Column | None = None) -> DataFrame:
        """``df`` with the ids in ``col`` as uuids (of version 4)."""
        # the hash is computed once per row in its own projection
        hashed = df.select("*", (F.lit("4") if version is None else version).alias("_v"), F.md5(F.col(col)).alias("_h"))
        h = F.col("_h")
        return hashed.withColumn(col, F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.col("_v"), F.substring(h, 14, 3),
            F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))).select(*df.columns)

    @cached_property
    def uuid_requests(self) -> DataFrame:
        """Requests by uuid; those for some events have the wrong version."""
        version = F.when(F.col("event_id").cast("bigint") % 31 == 0, F.lit("1")).otherwise(F.lit("4"))
        return self.with_uuid(self.requests.select("id", "user_id", "quantity", "event_id", "created_at"), "event_id",
                              version)

    @cached_property
    def orphan_bookings(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        return self.bookings.select(
            "id",
            F.when(u.cast("bigint") % 97 == 0, F.concat(F.lit("x"), u)).otherwise(u).alias("user_id"),
            F.when(e.cast("bigint") % 89 == 0, F.concat(F.lit("x"), e)).otherwise(e).alias("event_id"),
            "quantity", "status")

    @cached_property
    def counters(self) -> DataFrame:
        idn = F.col("id").cast("bigint")
        table = self.events.where(idn % 10 != 3).select(
            F.concat(F.lit("event:remaining:"), F.col("id")).alias("key"),
            (F.col("capacity") - F.when(idn % 9 == 0, 1).otherwise(0)).cast("int").alias("remaining"))
        extra = self.spark.createDataFrame([("event:remaining:x1", 5), ("booking:pending:x2", 1)],
                                           "key string, remaining int")
        return table.unionByName(extra)

    @cached_property
    def event_patches(self) -> DataFrame:
        idn = F.col("id").cast("bigint")
        return self.events.where(idn % 4 == 0).select(
            "id",
            F.when(idn % 8 == 0, F.concat(F.col("name"), F.lit(" (new)"))).alias("name"),
            F.when(idn % 12 == 0, F.floor(F.col("capacity") / 2).cast("int"))
             .when(idn % 12 == 4, F.col("capacity") * 2).alias("capacity"),
            F.when(idn % 16 == 0, F.col("ticket_price_cents") + 500).alias("ticket_price_cents"))

    @cached_property
    def profile_patches(self) -> DataFrame:
        idn = F.col("id").cast("bigint")
        return self.users.where(idn % 3 == 0).select(
            F.col("id").alias("target_id"),
            F.when(idn % 6 == 0, F.concat(F.col("id"), F.lit("0"))).otherwise(F.col("id")).alias("caller_id"),
            F.when(idn % 9 == 0, F.lit(None).cast("string")).when(idn % 10 == 0, F.lit("A"))
             .otherwise(F.concat(F.lit("Name "), F.col("id"))).alias("full_name"))

    @cached_property
    def registrations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            _s(k).alias("request_id"),
            F.when(k % 10 == 0, F.lit("no-at-sign"))
             .when(k % 4 == 0, F.concat(F.lit("user"), _s(k), F.lit("@example.com")))
             .otherwise(F.concat(F.lit("new"), _s(k % 40), F.lit("@example.com"))).alias("email"),
            (4 + k % 64).cast("int").alias("password_length"))
