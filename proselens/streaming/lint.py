"""Streams: the same stateless rules over arriving documents, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def lint_stream(docs: DataFrame, rules: list[Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch of documents(path, text) goes through the rules; `sink` gets its findings and the batch's number. The
    number makes a repeated batch overwrite itself."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        out = rules[0](kept)
        for rule in rules[1:]:
            out = out.unionByName(rule(kept))
        sink(out, number)
        kept.unpersist()

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and tumbling window; those later than the watermark are left out of closed windows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
