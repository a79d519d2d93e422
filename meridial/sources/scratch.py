"""Written tables between steps: they end a lineage, and a lost executor costs no more than one step."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where none is named and Spark runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named.rstrip('/') if named else 'file://' + tempfile.mkdtemp(prefix='meridial-')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new shared folder, which stays there until the folder is cleared."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done.

    It does so when the driver collects garbage, which a driver with little to
    do hardly ever needs.
    """
    gc.collect()
    spark._jvm.System.gc()
