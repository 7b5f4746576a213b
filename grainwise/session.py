"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What the operators rely on. AQE does the run-time sizing: it coalesces small
# shuffle partitions, splits skewed join partitions and turns a shuffle join
# into a broadcast join only once the measured side is under the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


SHUFFLE_PARTITION_BYTES = 128 << 20


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """Partitions to start a shuffle of that size with; AQE merges what turns out small.

    At 100 TB the default of 200 would make partitions of 500 GB.
    """
    return max(cores, -(-shuffled_bytes // SHUFFLE_PARTITION_BYTES))


def configure(builder: SparkSession.Builder, shuffled_bytes: int | None = None, cores: int = 200) -> SparkSession.Builder:
    """Operator settings; with the expected shuffle size, also the partition count."""
    if shuffled_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions(shuffled_bytes, cores))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local-master session without that setting (tests) gets a temporary
    folder; on a cluster a machine-local folder would be lost with its executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="grainwise-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing was written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A frame of a few rows computed now and kept as a literal table.

    For report-sized frames only: one row per column of a table, or one row.
    """
    return df.sparkSession.createDataFrame(df.toArrow())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
