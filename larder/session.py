"""Session construction and shared-folder checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale:
# * AQE re-plans joins from runtime sizes (sort-merge -> broadcast when a side
#   turns out small), coalesces tiny shuffle partitions and splits skewed ones.
# * The static broadcast threshold stays at Spark's default (10 MB); no table of the
#   restaurant is hinted: AQE decides from runtime sizes.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints of iterative jobs are removed once no plan references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


MAX_SHUFFLE_PARTITIONS = 50_000


def scale_settings(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for ``input_bytes`` of parquet input.

    One shuffle partition per ``partition_bytes`` of input, at most
    MAX_SHUFFLE_PARTITIONS: the driver tracks map tasks x partitions, so very
    large inputs get larger partitions instead (2 GB at 100 TB, which Spark
    sorts and aggregates with spilling).  Scan splits grow alike, so map
    tasks stay in the same range.  Shuffles here are at most the size of the fact tables they read,
    usually much less after map-side aggregation; AQE coalesces the small ones and splits
    skewed ones.  The settings change the layout of the work, never a result.
    """
    n = min(MAX_SHUFFLE_PARTITIONS, max(1, -(-input_bytes // partition_bytes)))
    size = max(partition_bytes, -(-input_bytes // n))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(size),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * size),
    }


def build_session(master: str | None = None, app: str = "larder",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with the settings above.

    On a cluster ``master`` stays None (spark-submit decides) and
    ``shuffle_partitions`` should be sized so one partition is ~128-256 MB of
    shuffle data; locally it is the core count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it (a folder every executor can reach).  Only on a local
    master (one process, as in tests) an unset folder is created here; on a
    cluster it is an error, since a folder of this machine would not be shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="larder-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (reliable checkpoint).

    Used between rounds of iterative jobs so a lost executor recomputes from
    the last checkpoint instead of replaying every round.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage as a
    checkpoint does, in compressed columns of which a reader takes those that it needs."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
