"""The incremental loads as Structured Streaming jobs.

Each runs once over what is new (AvailableNow) and keeps its progress and state
in a checkpoint folder, so a rerun after a lost executor or driver goes on where
it stopped; the sinks are keyed, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.sinks import upsert


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files at ``path`` (a folder, or one file)."""
    batch = spark.read.parquet(path)
    first = batch.select("_metadata.file_path").limit(1).collect()
    reader = spark.readStream.schema(batch.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, name = path.rstrip("/").rsplit("/", 1)
    if first and first[0][0].rsplit("/", 1)[1] == name:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_daily_counts(events: DataFrame, moment: str, kind: str, lateness: str, target: str, checkpoint: str) -> None:
    """Rows per day and kind in tumbling one-day windows, upserted as they grow."""
    counts = (
        events.withColumn("_t", F.col(moment).cast("timestamp"))
        .withWatermark("_t", lateness)
        .groupBy(F.window("_t", "1 day").alias("_w"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("_w.start").alias("day"), kind, "n")
    )

    def save(batch: DataFrame, _epoch: int) -> None:
        upsert(target, batch, {kind: F.col(kind)}, "day", [F.desc("n")])

    _run(counts.writeStream.outputMode("update").foreachBatch(save), checkpoint)


def stream_distinct(events: DataFrame, moment: str, key: str, lateness: str, target: str, checkpoint: str) -> None:
    """One row per key within the lateness. A stream keeps any one of the rows
    of a key; which one is fixed only in the batch form (first write wins)."""
    unique = (
        events.withColumn("_t", F.col(moment).cast("timestamp"))
        .withWatermark("_t", lateness)
        .dropDuplicatesWithinWatermark([key])
        .drop("_t")
    )
    _run(unique.writeStream.outputMode("append").format("parquet").option("path", target), checkpoint)


def stream_upsert(events: DataFrame, prepare, keys, partition: str, order, target: str, checkpoint: str) -> None:
    """Each micro-batch, prepared, upserted into a partitioned table."""

    def save(batch: DataFrame, _epoch: int) -> None:
        upsert(target, prepare(batch), keys, partition, order)

    _run(events.writeStream.foreachBatch(save), checkpoint)


def stream_in_time(events: DataFrame, moment: str, key: str, lateness: str, target: str, checkpoint: str) -> None:
    """Rows that are not later than the watermark of the batches before them, once per key.

    The watermark is the newest moment seen so far less ``lateness``; rows
    behind it are dropped by the stateful step, here the one on the key.
    """
    kept = events.withColumn("_t", F.col(moment).cast("timestamp")).withWatermark("_t", lateness).dropDuplicates([key, "_t"]).drop("_t")
    _run(kept.writeStream.outputMode("append").format("parquet").option("path", target), checkpoint)


# Moments keep their microseconds on the way through the state.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def first_writes(events: DataFrame, moment: str, keys: Sequence[str], order: Sequence[str], hold_seconds: int, lateness: str) -> DataFrame:
    """The earliest row of each key of a stream, by moment and then by ``order``, once no earlier one can come.

    State holds one row per key. A row that comes later but is earlier takes its
    place. When the watermark (newest moment less ``lateness``) passes the held
    moment plus ``hold_seconds``, the row is emitted and its key forgotten; rows
    behind the watermark are dropped. Where all rows of a key lie within
    ``hold_seconds``, the emitted rows are those of the batch form (first write
    wins); a key that comes again after that time starts anew. Null keys are one key.
    """
    schema = events.schema
    marked = events.where(F.col(moment).isNotNull()).select(
        F.to_json(F.struct(*[F.col(c) for c in keys]), {"ignoreNullFields": "false"}).alias("_key"), F.col(moment).cast("timestamp").alias("_t"),
        F.unix_micros(F.col(moment).cast("timestamp")).alias("_at"), F.concat_ws(",", *[F.lpad(F.col(c).cast("string"), 40, " ") for c in order]).alias("_then"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]), _EXACT).alias("_row"))

    def earliest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, row = state.get
            state.remove()
            yield pd.DataFrame({"_row": [row]})
            return
        best = state.get if state.exists else None
        for frame in frames:
            for found in zip(frame["_at"].tolist(), frame["_then"].tolist(), frame["_row"].tolist()):
                best = found if best is None or found[:2] < tuple(best)[:2] else best
        state.update(tuple(best))
        state.setTimeoutTimestamp(max(best[0] // 1000 + hold_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    held = marked.withWatermark("_t", lateness).groupBy("_key").applyInPandasWithState(
        earliest, "_row string", "at long, then string, row string", "append", GroupStateTimeout.EventTimeTimeout)
    return held.select(F.from_json("_row", schema, _EXACT).alias("r")).select("r.*")


def stream_first_writes(events: DataFrame, moment: str, keys: Sequence[str], order: Sequence[str], hold_seconds: int, lateness: str, target: str, checkpoint: str) -> None:
    """``first_writes`` into a Parquet folder."""
    won = first_writes(events, moment, keys, order, hold_seconds, lateness)
    _run(won.writeStream.outputMode("append").format("parquet").option("path", target), checkpoint)


def first_writes_in_windows(events: DataFrame, moment: str, keys: Sequence[str], order: Sequence[str], window_seconds: int, lateness: str) -> DataFrame:
    """The earliest row of each key and fixed window of a stream, by moment and then by ``order`` (nulls last), once no earlier one can come.

    Windows begin at multiples of ``window_seconds`` since 1970. State holds one row per key and window, kept by
    Spark's own aggregate; the row is emitted when the watermark (newest moment less ``lateness``) passes the end of
    the window. Rows of a window that has ended are dropped, as are rows without a moment. Null keys are one key.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    place = F.struct("_t", *[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    return (
        events.where(F.col(moment).isNotNull())
        .withColumn("_t", F.col(moment).cast("timestamp"))
        .withWatermark("_t", lateness)
        .groupBy(F.window("_t", f"{window_seconds} seconds"), *keys)
        .agg(F.min_by(row, place).alias("_row"))
        .select("_row.*")
    )


def stream_first_writes_in_windows(events: DataFrame, moment: str, keys: Sequence[str], order: Sequence[str], window_seconds: int, lateness: str, target: str, checkpoint: str) -> None:
    """``first_writes_in_windows`` into a Parquet folder."""
    won = first_writes_in_windows(events, moment, keys, order, window_seconds, lateness)
    _run(won.writeStream.outputMode("append").format("parquet").option("path", target), checkpoint)
