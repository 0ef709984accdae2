"""The queue's poll loop and file extraction as Structured Streaming, and windowed counts over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import normalize_pages
from lectern.operators.providers import Extractor, extract_or_error


def event_stream(spark: SparkSession, folder: str, schema, files_at_once: int = 16) -> DataFrame:
    """A stream over a folder of Parquet files, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours", by: str = "event_type") -> DataFrame:
    """Events and their sum of value by window; late ones count until the watermark passes, or always without one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming and late else timed
    return timed.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")).select(F.col("w.start").alias("window_start"), by, "n", F.col("value").cast("double").alias("value"))


def counted(stream: DataFrame, out: str, checkpoint: str, late: str | None = "2 hours", by: str = "event_type") -> DataFrame:
    """tumbling_counts() of all that a stream has so far. Each micro-batch writes the windows that it changed under its number, so one that comes again replaces itself; of each window the last count is read."""
    windows = tumbling_counts(stream, late=late, by=by)
    writer = windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start().awaitTermination()
    told = stream.sparkSession.read.schema(f"{windows.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, batch long").parquet(out)
    return told.groupBy("window_start", by).agg(F.max_by(F.struct("n", "value"), "batch").alias("s")).select("window_start", by, "s.n", "s.value")


def latest_by_key(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of many transitions of a job in a batch, the last."""
    columns = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(key, "s.*")


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Hands each micro-batch to `handle`: all there is and then ends, or every so many seconds. A batch may come twice after a failure, so `handle` has to be idempotent by batch id or key."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def extracted(files: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """Files (path, content), batch or stream, to normalised text or an error; pages are normalised one by one."""
    rows = extract_or_error(files, make).withColumn("page_texts", normalize_pages(F.col("page_texts")))
    text = F.array_join("page_texts", "\n\n")
    blank = F.col("error_class").isNull() & (F.regexp_replace(text, r"\s+", "") == "")
    status = F.when(F.col("error_class").isNotNull() | blank, F.lit("error")).otherwise(F.lit("ready"))
    return rows.select("path", "page_texts", F.when(status == "ready", text).alias("extracted_text"), status.alias("extraction_status"), F.when(blank, F.lit("permanent_validation")).otherwise(F.col("error_class")).alias("error_class"), F.when(blank, F.lit("normalized extraction is empty")).otherwise(F.col("error_message")).alias("error_message"))
