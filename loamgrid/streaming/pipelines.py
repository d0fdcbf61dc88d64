"""The engine's series operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.storage import new_path


def stream_parquet(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A folder of Parquet files (or one file of a folder) as a stream with the schema of ``like``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def timed(df: DataFrame, time: str) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def window_stats(df: DataFrame, time: str, by: str, value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) window counts, sums and means; late rows within the watermark still count."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = timed(df, time).withWatermark(time, late).groupBy(w.alias("w"), F.col(by))
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total", "mean")


def sessions(df: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = timed(df, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(by))
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def distinct_readings(df: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Feed snapshots without repeats; the state is bounded by the watermark."""
    return timed(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def trailing_means(df: DataFrame, time: str, series: str, value: str, hours: int, late: str = "2 hours") -> DataFrame:
    """Hourly trailing means: sliding windows of ``hours`` by the hour, null under three quarters of the hours' readings."""
    g = timed(df, time).withWatermark(time, late).groupBy(F.window(time, f"{hours} hours", "1 hour").alias("w"), F.col(series))
    filled = F.size(F.collect_set(F.date_trunc("hour", time)))  # at most `hours` values
    return g.agg(F.when(filled >= 0.75 * hours, F.avg(value)).alias("mean")).select(series, F.col("w.end").alias("until"), "mean")


def alerts(df: DataFrame, condition: str, on_rows: Callable[[DataFrame, int], None]):
    """A writer that hands each micro-batch's rows over a threshold to ``on_rows``."""
    return df.writeStream.foreachBatch(lambda batch, n: on_rows(batch.where(condition), n))


def run_available(df: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Everything there is, once, appended to Parquet files that all tasks write: the catch-up run of a schedule.

    ``path`` and ``checkpoint`` default to fresh folders in the shared folder; with the same ones a later run goes on where this one ended. Rows of windows and sessions
    come out when the watermark has passed their end; those still open wait for the next run, and the state stays bounded by the watermark.
    """
    spark = df.sparkSession
    path, checkpoint = path or new_path(spark), checkpoint or new_path(spark)
    w = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
