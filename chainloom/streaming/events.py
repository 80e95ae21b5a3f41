"""Structured Streaming over event tables: windows, late data, sessions, dedup, incremental scores.

Every function maps a streaming frame to a streaming frame (a batch frame works as well,
which is what the SQL comparison uses).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chainloom.session import shared_dir


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(df: DataFrame, at: str, late: str | None) -> DataFrame:
    """With a watermark, which wants a time with zone; a batch frame and a stream without limit stay as they are."""
    if not late or not df.isStreaming:
        return df
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def windowed(df: DataFrame, at: str, by: list[str], size: str, value: str, slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Tumbling (or sliding) windows: ``start``, ``by``, ``n``, ``total``, ``mean``; rows later than ``late`` behind the greatest time are dropped from a stream."""
    src = _timed(df, at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = src.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total", "mean")


def sessions(df: DataFrame, at: str, by: list[str], gap: str, late: str | None = "1 hour") -> DataFrame:
    """Sessions closed by a pause of ``gap``: ``start``, ``end``, ``by``, ``n``."""
    src = _timed(df, at, late)
    g = src.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def once(df: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by ``late``."""
    return _timed(df, at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running_totals(df: DataFrame, key: str, at: str, value: str, idle: str = "1 hour") -> DataFrame:
    """A key's number of rows, sum and last time after each batch: ``key`` (string), ``n``, ``total``, ``last``.

    State is a few numbers a key and is dropped after ``idle`` of event time.
    """
    pause = int(pd.Timedelta(idle) / timedelta(milliseconds=1))

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for f in frames:
            n, total = n + len(f), total + float(f["v"].sum())
            last = max(last, int(f["at"].max().value // 1_000_000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + pause)
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total], "last": [pd.Timestamp(last, unit="ms")]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("v")).withWatermark("at", idle)
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, total double, last timestamp", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote, from the shared folder."""
    spark = stream.sparkSession
    import uuid

    base = f"{shared_dir(spark)}/chainloom/{spark.sparkContext.applicationId}/stream-{name}-{uuid.uuid4().hex[:8]}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def incremental_scores(stream: DataFrame, solution: DataFrame, key: str, prediction: str, truth: str, by: list[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Scores of arriving predictions against a static solution, per group and hour: ``start``, ``by``, ``n``, ``mae``."""
    joined = _timed(stream, at, late).join(solution, key)
    g = joined.groupBy(F.window(at, "1 hour").alias("w"), *by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(prediction) - F.col(truth))).alias("mae"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "mae")


def upsert_batches(stream: DataFrame, keys: list[str], order: Column, load, save):
    """``foreachBatch`` merge: the newest row of each key of a batch replaces the table's; returns the started query's writer.

    ``load() -> DataFrame`` and ``save(DataFrame)`` reach the table.
    """
    from chainloom.operators.rank import best_rows
    from chainloom.operators.registry import upsert

    def merge(batch: DataFrame, _: int) -> None:
        save(upsert(load(), best_rows(batch, keys, [order]), keys))

    return stream.writeStream.foreachBatch(merge)
