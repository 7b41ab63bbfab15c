"""Event streams: windowed counts, sessions, deduplication, running state; an extension for continuous input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema=None, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a folder of Parquet files, or one file; ``ts`` as a timestamp that watermarks take."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        folder, _, name = path.rpartition("/")
        path, reader = folder, reader.option("pathGlobFilter", name)
    df = reader.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(df: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by tumbling or sliding windows; rows later than ``late`` are left out by the engine."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = (df.withWatermark("ts", late) if df.isStreaming else df).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Events of a key with no gap as long as ``gap`` between them."""
    out = (df.withWatermark("ts", late) if df.isStreaming else df).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def once(df: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first event of each key; on a stream within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def running_totals(df: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, events, total) kept as state for each key and updated with every batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "events": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} bigint, events bigint, total double", "events bigint, total double", "update", "NoTimeout")
