"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset on a single machine, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/wardlight-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A fresh folder under run_dir."""
    return f"{run_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table, so that a lost executor costs no earlier step and nothing is computed twice."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables; for its end, when no result is left to be computed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
