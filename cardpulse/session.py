"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every cardpulse job relies on. AQE re-plans joins from runtime
# statistics (broadcast only after the shuffle output is measured), splits
# skewed join partitions and coalesces small shuffle partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Cluster sizing for ~100 TB inputs: start every shuffle with many partitions (about
# 60 MB each for a 2.5 TB shuffle) and let AQE coalesce them to ~256 MB; AQE can merge
# small partitions but cannot split a large one (except skewed join partitions), so
# the initial count must be high.  Input splits of 256 MB keep task counts sane.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
}


def _local_conf(master: str) -> dict:
    cores = master[len("local["):-1] if master.startswith("local[") else "1"
    n = 8 if cores == "*" else max(1, int(cores))
    return {"spark.sql.shuffle.partitions": str(n)}


def get_session(master: str | None = "local[8]", app: str = "cardpulse",
                extra: dict | None = None) -> SparkSession:
    """Session with the settings cardpulse relies on; ``master=None`` means a cluster
    (the submit command chooses it) and applies the large-input sizing."""
    builder = SparkSession.builder.appName(app)
    sizing = _local_conf(master) if master and master.startswith("local") else CLUSTER_CONF
    if master:
        builder = builder.master(master)
    for k, v in {**BASE_CONF, **sizing, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator and must be shared
    storage; only when it is unset (local tests) a scratch folder is created.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
        conf_dir = tempfile.mkdtemp(prefix="cardpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
