"""The monthly aggregate over a stream of transactions (an extension).

Exact medians need all values of a month, so a stream keeps count, sum and a
quantile sketch per segment and month; late rows are taken until the watermark
passes. A closed month is emitted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def monthly_segments(stream: DataFrame, keys: list[str], at: str, value: str, late: str = "45 days") -> DataFrame:
    """Count, mean and approximate median per month and segment.

    A calendar month has no fixed length, so rows are grouped by the first day
    of their month under 31-day watermarking of that day.
    """
    month = F.to_timestamp(F.trunc(at, "month"))
    return (
        stream.withColumn("month", month)
        .withWatermark("month", late)
        .groupBy("month", *keys)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.percentile_approx(value, 0.5, 10_000).alias("median_value"))
    )


def to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed months to a table, exactly once, with what is there processed at start."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
