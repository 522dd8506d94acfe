"""Shared folders, table access and exact-copy keys for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.session import ship


#: Rows and bytes of a batch that goes to Python; the same for every operator, as a plan reads them when it runs.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, bound the batches that Python gets, and let shuffle files go when a query has ended."""
    ship(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="liftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/liftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` of which every reader has been written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits over id and text: rows that repeat an id with another text stay apart, equal rows agree."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def whole(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns as one struct, which no name of an operator's own can clash with."""
    return F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns))


def unpacked(struct: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{struct}.`{c}`") for c in columns]
