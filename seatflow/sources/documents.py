"""Keyed result documents and gauge samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.schemas import GAUGE_REVENUE, GAUGE_TICKETS


def currency_text(cents) -> Column:
    """Whole cents as the shortest decimal text of cents / 100 (``750``,
    ``123.4``, ``123.45``), the way a JSON encoder prints that float.  Built
    from integers, so no float rounding enters the text."""
    c = F.col(cents) if isinstance(cents, str) else cents
    a = F.abs(c)
    whole, frac = (a / 100).cast("bigint").cast("string"), (a % 100).cast("int")
    body = (F.when(frac == 0, whole)
             .when(frac % 10 == 0, F.concat(whole, F.lit("."), (frac / 10).cast("int").cast("string")))
             .otherwise(F.concat(whole, F.lit("."), F.lpad(frac.cast("string"), 2, "0"))))
    return F.when(c < 0, F.concat(F.lit("-"), body)).otherwise(body)


def stats_documents(stats: DataFrame) -> DataFrame:
    """One document per event, key ``event:<id>:stats``, value the JSON
    object ``{"revenue":..,"tickets_sold":..}`` (keys sorted, as the service's
    encoder writes a map).  ``stats`` is A3's output."""
    doc = F.concat(F.lit('{"revenue":'), currency_text("revenue_cents"),
                   F.lit(',"tickets_sold":'), F.col("tickets_sold").cast("string"), F.lit("}"))
    return stats.select(F.concat(F.lit("event:"), F.col("event_id"), F.lit(":stats")).alias("key"),
                        "event_id", doc.alias("value"))


def write_stats_documents(docs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S6 sink: the whole keyed snapshot replaces the previous one (no
    expiry, last write wins)."""
    docs.write.mode("overwrite").format(fmt).save(path)


def gauge_samples(stats: DataFrame, ts: Column) -> DataFrame:
    """The two gauges per event in long form (metric, event_id, value,
    ts); ``stack`` unpivots inside the same stage, no shuffle."""
    wide = stats.select("event_id", F.col("tickets_sold").cast("double").alias("t"),
                        F.col("revenue").cast("double").alias("r"), ts.alias("ts"))
    return wide.select(
        F.expr(f"stack(2, '{GAUGE_TICKETS}', t, '{GAUGE_REVENUE}', r) AS (metric, value)"),
        "event_id", "ts").select("metric", "event_id", "value", "ts")


def write_gauges(samples: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S7 sink: samples are appended, partitioned by metric."""
    samples.write.mode("append").partitionBy("metric").format(fmt).save(path)
