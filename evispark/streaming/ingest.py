"""Streaming ingest and counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions.text import fingerprint


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Timestamps without a zone become timestamps, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_texts(records: DataFrame, ts: str = "ts", text: str = "text", late: str = "1 hour") -> DataFrame:
    """The first record of each text fingerprint within the watermark; the state of older ones is dropped."""
    return event_time(records, ts).withColumn("fp", fingerprint(F.col(text))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["fp"])


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """event_type, start, n, total by tumbling (or, with slide, sliding) windows."""
    e = event_time(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that end after a gap."""
    e = event_time(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; files and checkpoint make a restart exact."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
