"""Lookups by natural key: the rows stream past the keys and are not sorted."""

from seatflow.operators import joins as J
from seatflow.plans.fixtures import Fixtures


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_lookup_are_not_sorted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a@x", "e1"), (2, None, "e2"), (3, "b@x", None), (4, "a@x", "none")],
                                 "request_id int, email string, event_name string")
    users = spark.createDataFrame([("u1", "a@x"), ("u2", "b@x"), ("u3", None)], "id string, email string")
    events = spark.createDataFrame([("7", "e1"), ("8", "e2")], "id string, name string")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over large tables
    try:
        out = J.resolve_natural_keys(rows, users, events)
        assert "SortMergeJoin" not in _plan(out) and _plan(out).count("ShuffledHashJoin") == 2
        assert sorted((r["request_id"], r["user_id"], r["event_id"]) for r in out.collect()) == [
            (1, "u1", "7"), (2, None, "8"), (3, "u2", None), (4, "u1", None)]
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_requests_stream_past_their_events(spark, tmp_path):
    from datetime import date

    spark.createDataFrame([(1, 1, 2, 3, 4.0, date(1997, 1, 1))],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                          "l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 9, date(1997, 1, 1), "F")],
                          "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_orderstatus string"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, "part", "t", 5, 1.0)], "p_partkey bigint, p_name string, p_type string, p_size int, "
                          "p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert _plan(Fixtures(spark, str(tmp_path)).natural_key_rows).count("ShuffledHashJoin") == 1
