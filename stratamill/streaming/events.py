"""Event streams: windowed counts with a watermark, written as they close."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of a window and how late an event may come.
WINDOW, LATE = "1 hour", "2 hours"


def closed_windows(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, kind, n, total of an unbounded table of events: a row when its window closes."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE)
    found = timed.groupBy(F.window(ts, WINDOW).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs the stream over what there is now and returns what it wrote to the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stratamill-")
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
