"""Session settings the operators are designed for, and the shared work folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings worth setting on any cluster that runs these operators. Shuffle
#: partition counts are left to AQE coalescing from a generous starting number.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tag centroids keep one mean vector per tag and task (about 6 KB at 384
    # dimensions); the default of 128 keys would make them sort instead of hash.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
    # Arrow batches: 4,096 vectors of 384 floats are about 6 MB, texts may be larger.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


#: Bytes a shuffle partition should hold before AQE merges small ones, and most
#: partitions: the driver tracks map tasks times partitions.
PARTITION_BYTES = 128 * 1024 * 1024
MOST_PARTITIONS = 50_000


def configure(spark: SparkSession, shuffle_bytes: int = None) -> SparkSession:
    """Apply the run-time settings above to an existing session.

    ``shuffle_bytes`` is what the largest shuffle writes, not the input: most
    operators combine before they shuffle, and a few gigabytes are left of 100 TB.
    Shuffles then start with enough partitions to hold ``PARTITION_BYTES`` each,
    ``MOST_PARTITIONS`` at most; AQE merges the small ones. The joins that move
    whole rows are worth a setting of their own.
    """
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    if shuffle_bytes is not None:
        parts = max(spark.sparkContext.defaultParallelism,
                    min(-(-shuffle_bytes // PARTITION_BYTES), MOST_PARTITIONS))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="knowspark-")
    context.setCheckpointDir(own)
    return "file:" + own


def new_work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder; never reused between runs."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
