"""A leaderboard over a stream of measurements: tumbling windows, late data until the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """profile, window, n, avg_value; with ``late`` (for streams) older windows are closed."""
    d = events.withWatermark("ts", late) if late else events
    return d.groupBy(F.col("event_type").alias("profile"), F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 10).alias("avg_value"))


def start(spark: SparkSession, source: str, schema, checkpoint: str, name: str, width: str = "1 day", late: str = "2 days", path: str | None = None):
    """Streams Parquet files that arrive in a folder into finished windows: into Parquet below path, which grows with the windows, or, without one, into a table named name in the driver's memory (for looking at
    a few)."""
    events = spark.readStream.schema(schema).parquet(source)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = windowed(events, width, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.format("parquet").queryName(name).start(path) if path else w.format("memory").queryName(name).start()
