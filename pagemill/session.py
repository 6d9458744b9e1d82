"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "pagemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here is needed for right results; a cluster session may be used as it is.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # Page bytes grow many times after their shuffle, so small partitions are worth keeping.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        # The state of streams (every URL seen, every crawl's totals) lies on disk, and what is saved per batch is what changed.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint`` has a folder and return it.

    The folder named by ``spark.checkpoint.dir`` is used whenever it is set.  Only a local
    session may fall back to a temporary folder: executors of a cluster could not share it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="pagemill-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()
