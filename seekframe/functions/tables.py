"""Tables that cut a lineage: iterative operators write each step below the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        root = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="seekframe-")
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; it survives the loss of executors."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.seekframe_path = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``step`` that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.seekframe_path)
