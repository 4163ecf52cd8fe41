"""Session helpers shared by tests, the bench and the query registry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


MAX_SHUFFLE_PARTITIONS = 20_000


def cluster_conf(input_bytes: int, cores: int, checkpoint_dir: str) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of logs on ``cores``
    executor cores (to pass to ``SparkSession.builder.config``).

    Shuffle partitions start at one per GB of input (at least three waves of
    tasks, at most ``MAX_SHUFFLE_PARTITIONS``: map tasks times partitions is
    the number of blocks the driver tracks), and AQE coalesces them to
    128 MB after each stage; scans split at 256 MB; skewed joins are split; checkpoints go to
    the shared ``checkpoint_dir``."""
    mb128 = 128 * 1024 * 1024
    partitions = min(MAX_SHUFFLE_PARTITIONS, max(3 * cores, -(-input_bytes // (8 * mb128))))
    return {
        **{k: v for k, v in DEFAULT_CONF.items() if not k.startswith("spark.ui.show")},
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(mb128),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.files.maxPartitionBytes": str(2 * mb128),
        "spark.checkpoint.dir": checkpoint_dir,
    }


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "phonelens") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("PHONELENS_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``
    (or one already set on the context); it is only invented here when the
    session has none, which is the local/test case.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="phonelens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Cut lineage: write ``df`` to the session's checkpoint folder (a
    shared folder on a cluster) and read it back, so a multi-pass operator
    does not recompute its input, and lost executors cost a re-read, not a
    re-run of the upstream plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
