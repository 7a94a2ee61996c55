"""Session helpers: where intermediate tables live and how lineage is cut.

Intermediate results are written as parquet tables below the shared folder that the cluster names in
``spark.checkpoint.dir``. A written table survives the loss of any executor, carries exact size
statistics for the next join decision, and is never recomputed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pixelkin")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark reads it with, so that file access inside tasks finds the same folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a private one only for a local master without setting."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return qualified(spark, configured).rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pixelkin-"))
    return qualified(spark, context.getCheckpointDir()).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once below the scratch folder and continue from the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Added:
    """A table below the scratch folder that grows by whole folders: what was written stays as it is."""

    def __init__(self, tag: str, spark: SparkSession):
        self._spark = spark
        self._base = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._paths: list[str] = []

    def add(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Write ``df`` as one more folder: the table so far, and the new rows alone."""
        path = f"{self._base}/{len(self._paths)}"
        df.write.parquet(path)
        self._paths.append(path)
        read = self._spark.read.schema(df.schema)
        return read.parquet(*self._paths), read.parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
