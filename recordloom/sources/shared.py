"""Tables that several parts of one query read, written once to the folder that all executors share."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one for a local session, as in tests.

    On a cluster an unset folder is an error: executors would write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(tempfile.mkdtemp(prefix="recordloom-"), "shared")
        spark.sparkContext.setCheckpointDir(at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """`df` written under `shared_dir` and read again, so that costly steps run once.

    This cuts the lineage: what follows survives lost executors without computing `df` again.  The files
    stay until the cluster empties the folder, as results may still be read from them.
    """
    path = f"{shared_dir(df.sparkSession)}/recordloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
