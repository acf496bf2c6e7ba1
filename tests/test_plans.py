"""Plan properties the operators rely on: filters reach the Parquet scan,
only the needed columns are read, aggregates combine before the shuffle."""

from pyspark.sql import functions as F

from seatflow.operators import select as P
from seatflow.operators import stats as A
from seatflow.session import scratch_path
from seatflow.sources.tables import read_table, write_bookings

ROWS = [(f"b{i}", f"u{i % 7}", f"e{i % 5}", 1 + i % 4, 1000 + i, ["PENDING", "CONFIRMED", "CANCELLED"][i % 3],
         f"2024-01-0{1 + i % 5} 10:00:00", f"2024-01-0{1 + i % 5} 11:00:00") for i in range(60)]
SCHEMA = ("id string, user_id string, event_id string, quantity int, unit_price_cents long, status string, "
          "created_at string, updated_at string")


def _table(spark):
    path = scratch_path(spark, "plan-bookings")
    df = (spark.createDataFrame(ROWS, SCHEMA).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
          .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")))
    write_bookings(df, path)
    return read_table(spark, path, "bookings")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_filter_and_pruning_reach_the_scan(spark):
    b = _table(spark)
    plan = _plan(P.pending_older_than(b, "2024-01-03T00:00:00Z").select("id"))
    assert "PushedFilters" in plan and "EqualTo(status,PENDING)" in plan
    assert "LessThan(created_at" in plan
    plan2 = _plan(b.where(F.col("created_date") == F.lit("2024-01-02").cast("date")).select("id"))
    assert "PartitionFilters: [isnotnull(created_date" in plan2


def test_confirmed_totals_partial_aggregate_and_pruned_columns(spark):
    b = _table(spark)
    df = A.tickets_sold(b)
    df.collect()
    plan = _plan(df)
    assert "EqualTo(status,CONFIRMED)" in plan
    # only the columns the aggregate needs are read
    scan = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert scan and all("user_id" not in line for line in scan)
    assert "partial_sum" in plan
