"""Structured Streaming over arriving batch documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetlake.operators.shred import adjacency, annotation_entities
from facetlake.session import written


def shred_stream(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes annotations, memberships and elements of a stream (raw_id, payload) below ``out``; a batch that is run again overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        nodes = written(adjacency(batch, "batch_raw", "raw_id", F.col("payload")))
        for name, df in zip(("annotations", "memberships", "elements"), annotation_entities(nodes)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(documents: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Documents and batches per window of ``received_at``; what comes later than ``late`` behind the newest is left out."""
    at = documents.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("n_documents"), F.approx_count_distinct("batch_id").alias("n_batches")).select(F.col("window.start").alias("window_start"), "n_documents", "n_batches")
