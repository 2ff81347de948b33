"""Session construction and shared-storage helpers.

On a cluster the session is created by the platform and its configuration wins; the
helpers here build sessions for tests and benches, and use the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings of the sessions that ``get_spark`` builds; an active session keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # text features are small in bytes but CPU-heavy: do not let AQE merge such stages into
    # one task (large inputs are far above this size, so it only matters for small data)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Folders of local sessions that name none, by application.
_local_dirs: dict[str, str] = {}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "relevo") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("RELEVO_DRIVER_MEM", "8g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which every executor must reach.

    Where the setting is absent, a local session (tests, benches) gets a folder of its own; a session
    on a cluster is refused, since executors couldn't read each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = _local_dirs.get(spark.sparkContext.applicationId)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _local_dirs[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="relevo-ckpt-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Bytes of a batch that Spark hands to Python; the default, rows only, would let long texts make batches of gigabytes.
ARROW_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, unless it has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = (spark.conf.get(key, None) or "").rstrip("b")  # other units are left as they are set
    if not have or have.isdigit() and int(have) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the checkpoint folder.

    Reliable across executor loss (the files live in shared storage), and the
    re-read table keeps column pruning and filter pushdown for later stages.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
