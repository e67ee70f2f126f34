"""Documents that arrive as files become postings, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.search import build_bm25


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string", files: int = 100) -> StreamingQuery:
    """Start a stream that writes postings of new Parquet files below source to target, a folder for each batch.

    A batch that runs again after a failure overwrites its own folder, so nothing counts
    twice. Terms and totals are sums over the postings, made when an index is opened.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks = batch.select(F.col("doc_id").alias("chunk_id"), "text")
        build_bm25(chunks).postings.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def postings(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type of a stream (ts, event_type, value); rows later than the watermark are left out."""
    window = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
