"""Continuous ingest: a folder of document tables feeds the index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from passagemill.engine import Engine


def watch(spark: SparkSession, folder: str, schema: str = "source string, title string, text string, arrived timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def ingest_stream(engine: Engine, documents: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every micro-batch replaces its sources in one commit.  A source that comes twice in a batch
    counts by its latest row; a batch that is run again gives the same index."""

    def write(batch: DataFrame, _: int) -> None:
        latest = Window.partitionBy("source").orderBy(F.col("arrived").desc_nulls_last(), F.col("text"))
        rows = batch.where("source is not null").withColumn("n", F.row_number().over(latest)).where("n = 1")
        engine.ingest_table(rows, "source", "text", "title")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), key, "n")
