"""Session settings the operators rely on, and the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Timestamps are UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when that costs one more shuffle downstream:
    # every consumer here pre-aggregates before it shuffles.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

MARKET_CONF = {
    # Spark plans a broadcast by the size of files, and columns of ids and names shrink in
    # Parquet to a twentieth and less: millions of users would go through the driver.
    "spark.sql.sources.fileCompressionFactor": "20",
}


def prepare(spark: SparkSession, conf: dict[str, str] = RUNTIME_CONF | MARKET_CONF) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in conf.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, used for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a folder of its own; a cluster without one is an error,
    because a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            current = tempfile.mkdtemp(prefix="gavel-")
        sc.setCheckpointDir(current)
    return current.rstrip("/")
