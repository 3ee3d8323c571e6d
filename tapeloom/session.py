"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI and AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's `spark.checkpoint.dir`.

    Where the cluster names none, only a session in local mode gets a temporary
    folder, remembered in the session; on a cluster the executors would each
    write to a disk of their own, so that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tapeloom.scratch.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if master.partition("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tapeloom.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Used where several passes need identical values: float sums may differ in
    their last bits when a shuffle is recomputed, so a frame that is ranked and
    then joined back is written first. The parquet copy survives executor loss
    and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash by keys into `spark.sql.shuffle.partitions` tasks, kept as they are.

    Adaptive execution merges small shuffles by size; a window that costs far
    more CPU than its bytes suggest should keep all its tasks. Windows on the
    same keys reuse this layout, so it replaces their exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
