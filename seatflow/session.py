"""Spark session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: UTC clock, ANSI arithmetic (integer overflow
# raises instead of wrapping), adaptive execution with skew-join splitting.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_bytes: int, executor_cores: int = 4, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized to the data for a cluster run (pass to ``build_session``
    as ``extra``).

    Scan splits and shuffle partitions target ``target_partition_bytes``
    each, so one task's share fits comfortably in an executor core's memory
    and spills rarely; AQE coalesces small shuffle partitions and splits
    skewed ones (a key holding a third of the rows is cut into
    advisory-sized pieces for joins).  At 100 TB this gives about 400,000
    scan tasks and as many initial shuffle partitions, which AQE then merges.
    """
    parts = max(200, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        # broadcasts only below a measured size; AQE re-plans from runtime sizes
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.executor.cores": str(executor_cores),
    }


# the subset that can be set on a running session
RUNTIME_CONF = {k: v for k, v in CORE_CONF.items() if k.startswith("spark.sql.")}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Put the SQL settings the operators rely on (UTC clock, ANSI, AQE) on a
    session someone else built."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def build_session(master: str | None = None, app: str = "seatflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with CORE_CONF.  On a cluster pass ``master=None`` and let the
    launcher decide; locally (tests, bench) pass ``local[N]``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and snapshot tables.

    The cluster names it in ``spark.checkpoint.dir``; that setting always
    wins.  Only a local session without one (tests, bench) gets a fresh
    scratch folder; a cluster session without one is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        # Spark appends a folder of its own to the configured one
        path = configured.split(":", 1)[-1].replace("//", "").rstrip("/")
        if not current or path not in current:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS)")
    local = tempfile.mkdtemp(prefix="seatflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def ranged(df: DataFrame, order: list[str], name: str, out: str = "_range", partitions: int | None = None,
           keep: dict | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` and stored, with the number of
    each row's range in ``out``: a bucket that never falls along ``order`` and
    holds about as many rows as any other, however hot a key or an instant is
    (``order`` should end in a column that breaks ties).  Stored because the
    range borders are sampled and another run could draw others.  ``keep``
    gives columns to be stored otherwise than they were ordered by."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id())
    return reliable_checkpoint(placed.withColumns(keep) if keep else placed, name)


def reliable_checkpoint(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read
    it back: lineage is cut, the plan runs once (an RDD checkpoint would run
    it twice), and a lost executor costs no recomputation.  Never a local
    checkpoint: it would be lost with its executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
