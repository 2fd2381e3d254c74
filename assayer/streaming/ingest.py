"""Extensions for streams: cache ingest and running metrics over new prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cache import RESULTS_SCHEMA, CacheTable


def read_results(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESULTS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def into_cache(stream: DataFrame, table: CacheTable, checkpoint: str) -> StreamingQuery:
    """Upserts every micro-batch; a batch that is replayed after a failure changes nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, _: table.upsert(rows)).start()


def running_accuracy(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, end, n, accuracy) of (prediction, reference) events by tumbling window."""
    right = (F.col("prediction") == F.col("reference")).cast("double")
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy")).select("window.start", "window.end", "n", "accuracy")


def windowed_counts(events: DataFrame, width: str = "1 day", time: str = "ts") -> DataFrame:
    """(start, event_type, n, total); the same plan serves a table and a stream."""
    return events.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
