"""Running streaming jobs over data that arrives in slices.

Production sources are message buses or landing folders; in tests and the
registered queries a fixture is staged into a landing folder one event-time
slice after the other, ``FILES`` files each, and one checkpointed query reads
that many files a micro-batch, so every slice is one micro-batch and state,
timers and the watermark carry from batch to batch exactly as in a
long-running job.  The last slice comes after a restart from the checkpoint.
All folders live under the shared checkpoint folder.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from seatflow.session import scratch_path

STATEFUL_CONF = {
    # transformWithState needs the RocksDB state store
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a micro-batch commits its changes, not a copy of the store's files
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a stream-stream join keeps one store per partition, not four
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


FILES = 4  # files of a slice


def enable_state_store(spark: SparkSession) -> None:
    for k, v in STATEFUL_CONF.items():
        spark.conf.set(k, v)


class ProgressLog(StreamingQueryListener):
    """What Spark reports about every micro-batch of the queries it listens to:
    the watermark it ran under, the rows refused as older than that, and the
    rows of state kept.  Unlike ``recentProgress`` it forgets no batch."""

    def __init__(self) -> None:
        self.batches: list[dict] = []
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run_id) -> threading.Event:
        return self.ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({
            "run_id": str(p.runId), "batch_id": p.batchId, "watermark": (p.eventTime or {}).get("watermark"),
            "dropped": sum(op.numRowsDroppedByWatermark for op in p.stateOperators),
            "state_rows": sum(op.numRowsTotal for op in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def of(self, query: StreamingQuery) -> list[dict]:
        """The batches of an ended query, once the last report is in."""
        if not self._end(query.runId).wait(60):
            raise TimeoutError("no end report of the query")
        return [b for b in self.batches if b["run_id"] == str(query.runId)]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def slice_numbers(df: DataFrame, ts_col: str, slices: int) -> Column:
    """Column with the event-time slice (0..slices-1) of every row; bounds
    come from one global min/max aggregate."""
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    width = max(1, (hi - lo) // slices + 1)
    return F.floor((us - F.lit(lo)) / F.lit(width)).cast("int")


class SliceReplay:
    """Stage ``source`` slice by slice and run one streaming query per slice.

    ``build(stream_df) -> DataStreamWriter`` defines the query (sink and
    output mode included); checkpoint and trigger are set here.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, name)
        self.source = f"{self.base}/landing"
        self.sink = f"{self.base}/sink"
        self.checkpoint = f"{self.base}/checkpoint"
        self.batches: list[dict] = []  # Spark's report of every batch, over all runs

    @property
    def dropped(self) -> int:
        """Rows refused as late."""
        return sum(b["dropped"] for b in self.batches)

    def watermarks(self) -> DataFrame:
        """batch_id and the watermark that Spark ran the batch under; a row per
        batch."""
        held = {b["batch_id"]: b["watermark"] for b in self.batches if b["watermark"]}
        rows = self.spark.createDataFrame(list(held.items()), "batch_id int, watermark string")
        return rows.withColumn("watermark", F.to_timestamp("watermark"))

    def run(self, source: DataFrame, slice_col: str, slices: list[int],
            build: Callable[[DataFrame], DataStreamWriter], extra: list[DataFrame] | None = None) -> str:
        """The source is computed once and written by slice.  All slices but
        the last are processed in one run of the query; the last one, and each
        frame of ``extra`` (e.g. heartbeat rows that move the watermark past
        the end), in a run of its own."""
        schema = source.drop(slice_col).schema
        source.write.partitionBy(slice_col).parquet(f"{self.base}/staged")
        staged = self.spark.read.parquet(f"{self.base}/staged")
        sizes = dict(staged.groupBy(slice_col).count().collect())  # one row per slice
        # a slice too small for one row per file would be fewer files
        files = FILES if min(sizes.values(), default=0) >= 1000 * FILES else 1
        held = [s for s in slices if sizes.get(s)]

        def stage(parts: list[DataFrame]) -> None:
            for part in parts:
                part.select([F.col(f.name) for f in schema]).repartition(files).write.mode("append").parquet(self.source)

        def process() -> None:
            stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(self.source)
            log = ProgressLog()
            self.spark.streams.addListener(log)
            try:
                q = build(stream).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
                q.awaitTermination()
                self.batches += log.of(q)
            finally:
                self.spark.streams.removeListener(log)

        slice_of = [staged.where(F.col(slice_col) == s) for s in held]
        for parts in [slice_of[:-1], slice_of[-1:], *([x] for x in extra or [])]:
            if parts:
                stage(parts)
                process()
        return self.sink
