"""The folder that driver and executors share: intermediate tables go there and nowhere else."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; one is made only where there is none and all runs on this machine."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's folder of intermediate tables, which goes when the application ends."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: one evaluation for many readers, and no lineage."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
