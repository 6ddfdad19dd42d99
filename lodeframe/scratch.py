"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. On one machine a temporary one serves
    where neither is set; on a cluster that is an error, since no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodeframe-')}")
    return context.getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new address in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one job in the shared folder, removed together once the job's result is written. What a job that fails leaves behind stays there."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """materialise(), remembered."""
        spark = df.sparkSession
        path = fresh_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for spark, path in self.paths:
            file = spark._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)
        self.paths = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive any executor. The caller's result reads it, so it stays."""
    return Scratch().keep(df, name)
