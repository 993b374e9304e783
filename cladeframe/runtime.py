"""Session helpers: the shared folder, checkpoints that survive lost executors, dense numbering."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cladeframe-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: str, name: str = "rec_no") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order without bringing the rows into one task.

    Rows are range-sorted and kept in place by a checkpoint; only a count per partition is summed.
    """
    placed = checkpoint(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).count()
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    rows = placed.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each partition
    return rows.withColumn(name, F.col("__before") + (F.col("__at") - F.shiftleft("__part", 33))).drop("__at", "__part", "__before")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than two for each core, dealt anew over four; a larger one stays as it is.

    For rows that become thousands each: a file of one row group would be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df
