"""Session helpers: build a session with sane defaults and find shared scratch space.

Nothing here overrides settings a cluster already supplies; defaults are only
applied when a key is unset, so the same code runs on local[8] and on a large
cluster where partition counts and the checkpoint folder come from spark-submit.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

SPREAD_CONF = "spark.optiq.spread.partitions"

# Defaults for a fresh local session. On a cluster the submitter's values win.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.ui.showConsoleProgress": "false",
    # Reliable checkpoints are removed once their DataFrame is garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Broadcast only what is proven small: 32 MB bound, AQE may re-plan below it.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Small local inputs have one split: spread() deals them out to this many tasks.
    SPREAD_CONF: "16",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "optiq") -> SparkSession:
    """The running session as it is, or a new one with the defaults for every
    key that neither the submitter nor the environment has set."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    submitted = SparkConf()
    defaults = dict(LOCAL_DEFAULTS)
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in defaults.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide scratch folder named by ``spark.checkpoint.dir``.

    When a local session has none (unit tests) a private folder is created and
    registered; on a cluster the setting is required, since executors can't
    share a machine's own folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="optiq-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for a written table."""
    base = shared_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
