"""Streaming delivery of the same stateless operators, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import StateTable


def incoming(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files: int = 100) -> DataFrame:
    """Files as they arrive, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def delivered(frame: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda d: d, form: str = "parquet", once: bool = True) -> StreamingQuery:
    """A stateless step over the stream, appended to a table exactly once."""
    writer = step(frame).writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(frame: DataFrame, ts: str, keys: Sequence[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = frame.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def by_session(frame: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Counts by session window."""
    out = frame.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def merged(frame: DataFrame, path: str, checkpoint: str, keys: Sequence[str], newest: str) -> StreamingQuery:
    """Each batch's newest row of a key, appended; readers take the last of each key."""

    def store(batch: DataFrame, _: int) -> None:
        columns = [c for c in batch.columns if c not in keys]
        batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), newest).alias("r")).select(*keys, "r.*").write.mode("append").parquet(path)

    return frame.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintained(frame: DataFrame, table: StateTable, source: str, checkpoint: str) -> StreamingQuery:
    """A stream of changes merged into a stored state. A batch's number is committed with its rows, so that a batch
    that is delivered again after a failure changes nothing."""
    store = lambda batch, number: table.merge(batch, source, number)
    return frame.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
