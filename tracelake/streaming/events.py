"""Structured Streaming over tool events: deduplication, windowed counts and a retry state machine."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import shared_dir, ship


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the parquet files of a table (a folder, or a pattern that names one file)."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First delivery of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, window: str, by: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there and stop; the result is a table in the shared folder, exactly once per batch."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "complete":

        def write(batch: DataFrame, _):
            batch.write.mode("overwrite").parquet(f"{base}/data")

        q = df.writeStream.outputMode("complete").foreachBatch(write)
    else:
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/data")
    q.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/data")


def attempt_states(stream: DataFrame, max_attempts: int = 3, expire: str | None = None) -> DataFrame:
    """Attempts (request_id, ok) -> state per request: running, completed, queued_retry or failed.

    ``ok`` is null for an attempt that has begun and not ended.  Keyed state holds the number of ended attempts; a
    completed request stays completed.  With ``expire`` the state of a request that nothing is heard of for so long
    (processing time) is dropped, and one that was not completed is then reported as ``expired``; this needs a query
    that keeps running, as one that only takes what is available would wait for it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    ship(stream.sparkSession)
    wait = int(pd.Timedelta(expire).total_seconds() * 1000) if expire else None

    def step(key, frames, state):
        n, done = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"request_id": [key[0]], "attempts": [n], "state": ["expired"]})
            return
        last = None
        for f in frames:
            for last in f["ok"].tolist():
                if last is not None and last == last:
                    n += 1
                    done = done or bool(last)
        state.update((n, done))
        if wait:
            state.setTimeoutDuration(wait)
        begun = last is None or last != last
        yield pd.DataFrame({"request_id": [key[0]], "attempts": [n], "state": ["completed" if done else "running" if begun else "failed" if n >= max_attempts else "queued_retry"]})

    return stream.groupBy("request_id").applyInPandasWithState(step, "request_id string, attempts int, state string", "attempts int, done boolean", "update", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)
