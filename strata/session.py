"""Session construction and the few session-level settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry. AQE re-plans joins and coalesces shuffle
# partitions at run time; skew-join splitting protects the few joins that must
# shuffle on a low-cardinality key.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "strata", driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench. On a cluster use the cluster's builder
    and call :func:`ensure_checkpoint_dir` once."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make reliable checkpoints possible.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used as
    is. Only a local session without that setting gets a private temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strata-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return sc.getCheckpointDir()
