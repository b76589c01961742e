"""Base frames: current segments, turns and classifications out of tables that hold repeated and corrected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convolens.operators.intervals import to_ms

#: Columns of a segment frame.
SEGMENT = ["show", "episode_id", "segment_id", "text", "speaker", "start_ms", "end_ms", "speaker_name"]


def named_speaker(label: Column) -> Column:
    """The label, UNKNOWN for null and empty ones."""
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("UNKNOWN"))


def current_segments(segments: DataFrame) -> DataFrame:
    """One row per (episode_id, segment_id): the latest delivery, of ties the greatest values; nulls become defaults.

    text '' and times 0 where null; nulls in the key are values of their own.
    """
    cols = ["ingested_at", "start", "end", "speaker", "text", "show", "speaker_name"]
    r = segments.groupBy("episode_id", "segment_id").agg(F.max(F.struct(*cols)).alias("r"))
    ms = lambda c: F.coalesce(to_ms(F.col(c)), F.lit(0)).alias(c.split(".")[-1] + "_ms")
    return r.select("r.show", "episode_id", "segment_id", F.coalesce("r.text", F.lit("")).alias("text"), named_speaker(F.col("r.speaker")).alias("speaker"), ms("r.start"), ms("r.end"), "r.speaker_name")


def valid_segments(segments: DataFrame) -> DataFrame:
    """Segments that a strict parser accepts: no negative time, and no end before its start."""
    return segments.where("start_ms >= 0 and end_ms >= start_ms")


def with_index(segments: DataFrame) -> DataFrame:
    """Adds idx, the position in the episode in order of segment_id."""
    from pyspark.sql import Window as W

    return segments.withColumn("idx", F.row_number().over(W.partitionBy("episode_id").orderBy("segment_id")) - 1)


def current_turns(turns: DataFrame) -> DataFrame:
    """(episode_id, turn_ord, speaker_id, start_ms, end_ms): diarization turns with an end after the start, each once."""
    t = turns.select("episode_id", "turn_ord", F.col("speaker").alias("speaker_id"), to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"), "ingested_at")
    t = t.where("speaker_id is not null and end_ms > start_ms")
    return t.groupBy("episode_id", "turn_ord").agg(F.max(F.struct("ingested_at", "start_ms", "end_ms", "speaker_id")).alias("r")).select("episode_id", "turn_ord", "r.start_ms", "r.end_ms", "r.speaker_id")


def current_classifications(classifications: DataFrame) -> DataFrame:
    """(doc_id, model_name, label, confidence): of repeated runs of a model on a document the last one holds.

    Labels are trimmed and upper-cased ('toxic' stays as it is); confidences above 1 are percentages.
    """
    c = classifications.groupBy("doc_id", "model_name").agg(F.max(F.struct("run_at", "label", "confidence")).alias("r"))
    label = F.trim("r.label")
    label = F.when(F.lower(label).isin("toxic", "explicit"), F.lower(label)).otherwise(F.upper(label))
    conf = F.when(F.col("r.confidence") > 1, F.col("r.confidence") / 100).otherwise(F.col("r.confidence"))
    return c.select("doc_id", "model_name", label.alias("label"), conf.alias("confidence"))
