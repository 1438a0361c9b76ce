"""Local session defaults; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "tessel") -> SparkSession:
    """A local session in UTC with adaptive execution, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def capabilities(spark: SparkSession) -> dict[str, str]:
    """The session's counterparts of processor probes and of chunk, stack and unroll sizes."""
    conf = spark.conf.get
    return {
        "hw_capabilities": f"{spark.sparkContext.defaultParallelism} cores",
        "chunk_size_strings": conf("spark.sql.files.maxPartitionBytes"),
        "chunk_size_datasets": conf("spark.sql.shuffle.partitions"),
        "chunk_size_arrays": conf("spark.sql.inMemoryColumnarStorage.batchSize"),
        "quicksort_stack_size": conf("spark.sql.sort.enableRadixSort", "true"),
        "unroll_factor": conf("spark.sql.codegen.wholeStage", "true"),
    }


def has_support(spark: SparkSession, feature: str) -> bool:
    """Whether the session has a feature: ``codegen``, ``adaptive``, ``arrow`` or ``vectorized_reader``; others are false."""
    keys = {"codegen": "spark.sql.codegen.wholeStage", "adaptive": "spark.sql.adaptive.enabled", "arrow": "spark.sql.execution.arrow.pyspark.enabled", "vectorized_reader": "spark.sql.parquet.enableVectorizedReader"}
    return feature in keys and str(spark.conf.get(keys[feature], "false")).lower() == "true"
