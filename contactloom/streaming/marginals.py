"""Coverage of bins kept up as contacts arrive. Sums are additive, so the stream's totals equal the batch's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pixel_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("bin1_id long, bin2_id long, count long").parquet(folder)


def marginal_stream(pixels: DataFrame) -> DataFrame:
    ends = pixels.select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), "count")
    return ends.groupBy("bin_id").agg(F.sum("count").alias("coverage"), F.count(F.lit(1)).alias("nnz"))


def start(rows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """All that is there, in as many batches as it takes, into an in-memory table (for tests)."""
    return rows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
