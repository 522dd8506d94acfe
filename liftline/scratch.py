"""Tables written in the shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and all runs in one process (tests, benchmark)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="liftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/liftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
