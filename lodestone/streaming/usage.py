"""Usage facts as a stream: the batch rules on each row, and daily counts with bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import usage_rows


def usage_stream(events: DataFrame, question: Column, kind: Column, duration: Column) -> DataFrame:
    return usage_rows(events, question, kind, duration)


def daily_usage(usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, n); a day is final, and its state gone, once events are ``late`` past its end."""
    w = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = w.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def append(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, each row once also after a restart; once: what is there now, then stop."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 minute")).start()
