"""Table readers with the fixed schemas (S1, S2, S5, S8 helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatflow.schemas import ACCESS_LINE, DEFAULTS, TABLES


def conform(df: DataFrame, table: str, fill_defaults: bool = False) -> DataFrame:
    """Shape ``df`` to the fixed schema of ``table``.

    A column that already has its type passes through untouched, so filters
    on it still reach the scan (a cast or ``coalesce`` around it would stop
    Parquet/JDBC pushdown).  Other present columns are cast; absent ones get
    the store default (role USER, price 0, status PENDING, remaining =
    capacity) or NULL.  ``fill_defaults`` also puts defaults into NULLs of
    present columns, as on insert; reads leave stored values alone.  Columns
    outside the schema (e.g. partition columns) are kept at the end.
    Timestamps keep the kind they arrive with (Parquet without a zone gives
    ``timestamp_ntz``).
    """
    schema: T.StructType = TABLES[table]
    defaults = DEFAULTS.get(table, {})
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name in types:
            c = F.col(f.name)
            same = types[f.name] == f.dataType or (
                isinstance(f.dataType, T.TimestampType) and isinstance(types[f.name], T.TimestampNTZType))
            if not same:
                c = c.cast(f.dataType)
            if fill_defaults and f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
            elif fill_defaults and table == "events" and f.name == "remaining":
                c = F.coalesce(c, F.col("capacity"))
        elif f.name in defaults:
            c = F.lit(defaults[f.name]).cast(f.dataType)
        elif table == "events" and f.name == "remaining":
            c = F.col("capacity").cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    extra = [c for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    """Read users / events / bookings with the fixed schema.

    Parquet carries its own schema and is conformed after the read (column
    pruning and filter pushdown still apply); text formats are read with the
    schema, never inferred.
    """
    reader = spark.read.options(**(options or {}))
    if fmt == "parquet":
        df = reader.parquet(path)
    else:
        df = reader.schema(TABLES[table]).format(fmt).load(path)
    return conform(df, table)


def jdbc_options(url: str, table: str, partition_column: str = "created_at", lower: str | None = None,
                 upper: str | None = None, num_partitions: int = 64, fetch_size: int = 10_000,
                 user: str | None = None, password: str | None = None) -> dict:
    """Options for S2: parallel range reads on ``partition_column`` so each
    task opens one connection and reads one slice."""
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownPredicate": "true"}
    if lower is not None and upper is not None:
        opts.update({"partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper,
                     "numPartitions": str(num_partitions)})
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    return opts


def read_jdbc_table(spark: SparkSession, table: str, **kwargs) -> DataFrame:
    """The same tables from the relational store through JDBC (needs the
    store's driver jar on the cluster; not testable in this container)."""
    return conform(spark.read.format("jdbc").options(**jdbc_options(table=table, **kwargs)).load(), table)


def parse_access_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """S5 on a column of log lines (batch or streaming): one record per
    request with ``ts`` as a timestamp and ``latency_ms``.  A line that does
    not parse keeps its text in ``_corrupt_record`` instead of failing."""
    schema = T.StructType(ACCESS_LINE.fields + [T.StructField("_corrupt_record", T.StringType())])
    r = F.from_json(F.col(line_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    keep = [c for c in lines.columns if c != line_col]
    return lines.select(*keep, line_col, r.alias("_r")).select(
        *keep,
        F.try_to_timestamp(F.col("_r.ts")).alias("ts"),
        *[F.col(f"_r.{c}").alias(c) for c in ("level", "request_id", "method", "path", "status")],
        F.col("_r.latency").alias("latency_ms"),
        *[F.col(f"_r.{c}").alias(c) for c in ("client_ip", "user_agent", "user_id", "errors")],
        F.coalesce(F.col("_r._corrupt_record"), F.when(
            F.col("_r.ts").isNotNull() & F.try_to_timestamp(F.col("_r.ts")).isNull(), F.col(line_col))
        ).alias("_corrupt_record"))


def read_access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines access log files (rotated daily) read as text and
    parsed with the fixed line schema; nothing is inferred."""
    reader = spark.readStream if stream else spark.read
    return parse_access_lines(reader.text(path))


def write_bookings(bookings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Bookings laid out for the filters the service runs: one folder per
    day of ``created_at`` (partition pruning for time ranges) and rows sorted
    by (status, event_id) inside each file, so Parquet row-group statistics
    skip most groups for ``status = ... AND event_id = ...`` (the role the
    store's indexes play)."""
    (bookings.withColumn("created_date", F.to_date("created_at"))
     .repartition("created_date")
     .sortWithinPartitions("status", "event_id")
     .write.mode(mode).partitionBy("created_date").parquet(path))
