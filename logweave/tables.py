"""Tables that jobs keep between stages, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may do without: it gets a temporary one.

    On a cluster a folder made here would lie on one machine alone, so there the setting is demanded.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-logweave-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is written, so that a task holds few whole texts twice.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    rows = int(spark.conf.get(_BATCH))
    try:
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(_BATCH, rows)
    return spark.read.schema(df.schema).parquet(at)


def delete_folder(spark: SparkSession, at: str) -> None:
    """Deletes a folder in any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows, each of a few short columns, that are broadcast.
BROADCAST_ROWS = 250_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it has no more than so many rows; it is counted first. Others are joined by shuffles."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
