"""Continuous ingestion: documents that arrive in a folder are cleaned, chunked and tagged, and appended to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import DEFAULTS, EngineConfig
from docloom.plans.ingest import chunks_of, mentions_of

DOCUMENTS = "doc_name string, text string"


def document_stream(spark: SparkSession, folder: str, schema: str = DOCUMENTS, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(stream: DataFrame, out: str, checkpoint: str, config: EngineConfig = DEFAULTS) -> StreamingQuery:
    """Append chunks and mentions of every micro-batch under `out`, until all that is there has been read.

    A batch that is run again after a failure overwrites its own folder, so its rows stand once.
    """

    def each(batch: DataFrame, number: int) -> None:
        chunks = chunks_of(batch, config)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        again = batch.sparkSession.read.parquet(f"{out}/chunks/batch={number}")
        mentions_of(again).write.mode("overwrite").parquet(f"{out}/mentions/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events (ts, event_type, value) per window and type, rows later than the watermark dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def count_events(events: DataFrame, out: str, checkpoint: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_counts of a stream, run until all that is there has been read; what changes in a batch is written to a table.

    A batch's rows hold the counts so far, so the last batch of a window and type has its result. Nothing is kept on the
    driver; a batch that is run again overwrites its own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted = event_counts(events, window, late)
    counted.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = events.sparkSession.read.schema("start timestamp, event_type string, n long, total double, batch int").parquet(out)
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return last.select("start", "event_type", "last.n", "last.total")
