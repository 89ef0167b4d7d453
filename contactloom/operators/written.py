"""Cutting the lineage of iterative jobs with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary folder where that is unset, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *drop: DataFrame) -> DataFrame:
    """The rows written below the scratch folder and read again, so that a lost executor costs one round of an iteration;
    then the tables `drop` that this wrote, which nothing reads any more, go."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    for old in drop:
        dropped(old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffles(spark: SparkSession) -> int:
    """Parts of a shuffle, for rows that are few but take long: adaptive execution would put them together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
