"""Figures that arrive as a stream: duplicates of one content dropped under a watermark, sums by window, and periods appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_content(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each content; its state is dropped when the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sums by event-time window; rows later than the watermark are left out once their window is closed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All windows of what is there now, as a table: open ones too, which ``append_to`` would still hold back.

    Each batch writes the windows that it changed, under its own number, so that a batch which is run again replaces itself; a
    window's last batch counts. State is dropped by the watermark and nothing is gathered on the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    keys = [c for c in stream.columns if c not in ("n", "total")]
    if not _exists(spark, path):  # nothing has arrived: no batch was written
        return spark.createDataFrame([], stream.schema)
    written = spark.read.parquet(path)
    return written.groupBy(*keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("last")).select(*keys, "last.n", "last.total")


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: str):
    """Finished windows to partitioned Parquet: exactly once with the checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy(partition_by).trigger(availableNow=True).start()
