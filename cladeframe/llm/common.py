"""What the operators of this subpackage share: table access, words, checkpoints, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of characters other than space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Whitespace that separates words.
WS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: bytes.split() splits on exactly the six ASCII whitespace bytes of WS."""
    return data.split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without; it gets a temporary one."""
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context.getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="checkpoint-")
        else:
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the memory of Python workers: an Arrow batch has so many rows or 16 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
