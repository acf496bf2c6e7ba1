"""Booking messages: parse (S3) and emit (S4).  Work on batch and streaming
frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatflow.schemas import BOOKING_MESSAGE, ROUTING_KEY_CREATED

_PARSE_SCHEMA = T.StructType(BOOKING_MESSAGE.fields + [T.StructField("_corrupt", T.StringType())])


def parse_booking_messages(df: DataFrame, body_col: str = "body") -> DataFrame:
    """S3: decode JSON bodies into booking_id, user_id, event_id, quantity.

    ``parsed`` is false for a body that is not a JSON object of that shape;
    such rows are kept (for the reject table) instead of being dropped.
    """
    m = F.from_json(F.col(body_col), _PARSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return (df.withColumn("_m", m)
            .select(*[c for c in df.columns], *[F.col(f"_m.{f.name}").alias(f.name) for f in BOOKING_MESSAGE.fields],
                    (F.col("_m").isNotNull() & F.col("_m._corrupt").isNull()).alias("parsed")))


def read_booking_messages(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False,
                          schema: T.StructType | None = None, options: dict | None = None) -> DataFrame:
    """S3 source: message bodies from files (a message bus connector in
    production plugs in the same way); decoded with ``parse_booking_messages``."""
    reader = (spark.readStream if stream else spark.read).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return parse_booking_messages(reader.format(fmt).load(path))


def booking_messages(bookings: DataFrame) -> DataFrame:
    """One ``booking.created`` message per booking: routing key and JSON
    body with booking_id, user_id, event_id, quantity (in that order)."""
    return bookings.select(
        F.col("id").alias("booking_id"),
        F.lit(ROUTING_KEY_CREATED).alias("routing_key"),
        F.to_json(F.struct(F.col("id").alias("booking_id"), "user_id", "event_id", "quantity")).alias("body"))


def write_booking_messages(messages: DataFrame, path: str, fmt: str = "json", checkpoint: str | None = None):
    """S4 sink: append messages; a streaming frame goes through a checkpointed
    ``writeStream`` (at-least-once; consumers are idempotent, see T6)."""
    if messages.isStreaming:
        if not checkpoint:
            raise ValueError("a streaming sink needs a checkpoint location in shared storage")
        return (messages.writeStream.format(fmt).option("path", path)
                .option("checkpointLocation", checkpoint).outputMode("append").start())
    messages.write.mode("append").format(fmt).save(path)
    return None
