"""New files as a stream, windowed counts with late data, and turns counted online."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convolens.functions.text import count_words


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream; files that come later are read by later triggers (checkpointed)."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_deliveries(stream: DataFrame, keys: list[str], time: str = "ingested_at", late: str = "2 days") -> DataFrame:
    """Rows delivered twice within the watermark pass once."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window start, key, n, words): tumbling or sliding counts; rows later than the watermark are left out."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = s.groupBy(F.window(time, width, slide or width).alias("w"), key)
    extra = [F.sum(count_words(F.col("text"))).alias("words")] if "text" in stream.columns else []
    return g.agg(F.count("*").alias("n"), *extra).select(F.col("w.start").alias("start"), key, "n", *(["words"] if extra else []))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, key, n): sessions that a pause longer than ``gap`` ends."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = s.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def online_turns(stream: DataFrame) -> DataFrame:
    """(episode_id, turns, segments): turns so far of each episode, from segments arriving in order of segment_id.

    State per episode: the last speaker and two counters; segments within one batch are ordered first.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, turns, n = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("segment_id")
        for speaker in rows["speaker"]:
            speaker = speaker if isinstance(speaker, str) and speaker.strip() else "UNKNOWN"
            turns += speaker != last
            last, n = speaker, n + 1
        state.update((last, int(turns), int(n)))
        yield pd.DataFrame({"episode_id": [key[0]], "turns": [int(turns)], "segments": [int(n)]})

    s = stream.select("episode_id", "segment_id", "speaker")
    return s.groupBy("episode_id").applyInPandasWithState(update, "episode_id string, turns bigint, segments bigint", "last string, turns bigint, n bigint", "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Processes all files that are there, hands each batch to ``sink(df, batch_id)`` and ends; a rerun goes on after them."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
