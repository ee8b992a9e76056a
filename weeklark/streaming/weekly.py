"""Weekly demand from a stream of sales, for tables that the batch operators read.

Forecasting itself is a batch job over complete tables; a stream only keeps
the weekly sums current. Late rows are added up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..schema import DATE, ID, Y


def weekly_demand_stream(events: DataFrame, key: Column, ts_col: str, quantity: Column, delay: str = "14 days") -> DataFrame:
    """Sums by key and week-ending Sunday; a week is complete once the watermark has passed it."""
    marked = events.withWatermark(ts_col, delay)
    # Windows of seven days start on Thursdays (the epoch was one); four days later is Monday.
    week = F.window(ts_col, "7 days", "7 days", "4 days")
    sums = marked.groupBy(key.alias(ID), week.alias("w")).agg(F.sum(quantity).cast("double").alias(Y))
    return sums.select(ID, F.date_add(F.col("w.start").cast("date"), 6).alias(DATE), Y)


def write_weekly(weekly: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append finished weeks as Parquet; ``once`` takes what is there and stops."""
    writer = weekly.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
