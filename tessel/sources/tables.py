"""Reading tables, events with fields made of columns, and tables that a plan leaves for its next step."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files are deleted at its end, rather than when the driver comes to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fields_of(*names: str) -> Column:
    """Columns as an event's fields: an array of (name, value) with the values as text. Names may repeat."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one gets a folder made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessel-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table written in the shared folder: it cuts lineage and outlives the loss of any executor.

    Its shuffle files go as soon as the table is there; the table goes with ``release`` or at the driver's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    atexit.register(removed, spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t.written_at)


def removed(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        to = jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
