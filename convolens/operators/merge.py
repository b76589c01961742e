"""Runs of one speaker merged, speakers attached by overlapping turns, labels applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from convolens.functions.text import is_blank

E = ["show", "episode_id"]
#: Width of the time buckets that give the overlap join an equality to hash on.
BUCKET_MS = 60_000


def merge_consecutive(segments: DataFrame) -> DataFrame:
    """Runs of segments of one speaker as one: texts joined by a space, start of the first, end of the last."""
    w = W.partitionBy(*E).orderBy("segment_id")
    s = segments.withColumn("_new", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1)))
    s = s.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = s.groupBy(*E, "run", "speaker").agg(
        F.min("segment_id").alias("first_segment"), F.count("*").alias("n_segments"), F.min_by("start_ms", "segment_id").alias("start_ms"), F.max_by("end_ms", "segment_id").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    return g.select(*E, "run", "speaker", "first_segment", "n_segments", "start_ms", "end_ms", "text")


def merge_reduction(segments: DataFrame) -> DataFrame:
    """Per episode: segments before and after merging, and the reduction in per cent."""
    w = W.partitionBy(*E).orderBy("segment_id")
    s = segments.select(*E, F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1)).alias("_new"))
    g = s.groupBy(*E).agg(F.count("*").alias("original"), F.sum("_new").alias("combined"))
    return g.withColumns({"reduction": F.col("original") - F.col("combined"), "reduction_pct": F.round((F.col("original") - F.col("combined")) * 100 / F.col("original"), 2)})


def text_with_speakers(segments: DataFrame) -> DataFrame:
    """Per episode the text as '[speaker]: text' paragraphs, segments without text left out."""
    s = segments.where(F.col("text") != "").withColumn("line", F.format_string("[%s]: %s", "speaker", "text"))
    g = s.groupBy(*E).agg(F.array_sort(F.collect_list(F.struct("segment_id", "line"))).alias("x"))
    return g.select(*E, F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("text"))


def overlap_speakers(segments: DataFrame, turns: DataFrame, least_share: float = 0.1) -> DataFrame:
    """(episode_id, segment_id, speaker, overlap_ms): the speaker of the turn that overlaps each segment most.

    Of equal overlaps the turn of lowest turn_ord; UNKNOWN without a turn, or if the overlap is below ``least_share``
    of the segment. Both sides are spread over time buckets, so the join hashes on (episode, bucket) and a long or hot
    episode is many keys; a pair is counted in the bucket where its overlap begins.
    """
    spread = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / BUCKET_MS), F.floor(F.greatest(F.col("end_ms") - 1, F.col("start_ms")) / BUCKET_MS))))
    s = spread(segments.where("end_ms > start_ms").select("episode_id", "segment_id", "start_ms", "end_ms")).alias("s")
    t = spread(turns).alias("t")
    begin, end = F.greatest("s.start_ms", "t.start_ms"), F.least("s.end_ms", "t.end_ms")
    j = s.join(t, (F.col("s.episode_id") == F.col("t.episode_id")) & (F.col("s.bucket") == F.col("t.bucket")) & (F.col("t.start_ms") < F.col("s.end_ms")) & (F.col("t.end_ms") > F.col("s.start_ms")))
    j = j.where(F.floor(begin / BUCKET_MS) == F.col("s.bucket"))
    best = j.groupBy("s.episode_id", "s.segment_id").agg(F.max(F.struct((end - begin).alias("ov"), (-F.col("t.turn_ord")).alias("o"), F.col("t.speaker_id"))).alias("b"))
    best = best.select("episode_id", "segment_id", F.col("b.ov").alias("ov"), F.col("b.speaker_id").alias("sp"))
    out = segments.select("episode_id", "segment_id", "start_ms", "end_ms").join(best, ["episode_id", "segment_id"], "left")
    enough = F.col("ov") * int(round(1 / least_share)) >= F.col("end_ms") - F.col("start_ms")
    return out.select("episode_id", "segment_id", F.when(enough, F.col("sp")).otherwise(F.lit("UNKNOWN")).alias("speaker"), F.coalesce("ov", F.lit(0)).alias("overlap_ms"))


def combine_with_turns(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments of episodes that have turns, with the speaker of overlap_speakers and a flag that it was applied."""
    known = segments.join(turns.select("episode_id").distinct(), "episode_id", "left_semi")
    return known.drop("speaker").join(overlap_speakers(known, turns), ["episode_id", "segment_id"]).withColumn("diarization_applied", F.lit(True))


def episodes_without_turns(segments: DataFrame, turns: DataFrame) -> DataFrame:
    return segments.select(*E).distinct().join(turns.select("episode_id").distinct(), "episode_id", "left_anti").select(*E)


def apply_labels(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds the speaker's name from mapping (episode_id, speaker, name), or the label itself."""
    m = mapping.select("episode_id", "speaker", "name")
    return segments.drop("speaker_name").join(m, ["episode_id", "speaker"], "left").withColumn("speaker_name", F.coalesce("name", "speaker")).drop("name")


def utterance_context(segments: DataFrame, hits: DataFrame, reach: int = 2) -> DataFrame:
    """(episode_id, hit_id, segment_id, offset, text): the ``reach`` segments around each hit (episode_id, segment_id)."""
    near = hits.select("episode_id", F.col("segment_id").alias("hit_id")).distinct().withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    near = near.withColumn("segment_id", F.col("hit_id") + F.col("offset"))
    return near.join(segments.select("episode_id", "segment_id", "speaker", "text"), ["episode_id", "segment_id"]).select("episode_id", "hit_id", "segment_id", "offset", "speaker", "text")


def context_window(segments: DataFrame, reach: int = 3) -> DataFrame:
    """Each segment that says something with the ``reach`` segments before and after it, as arrays of structs."""
    w = W.partitionBy(*E).orderBy("segment_id")
    x = F.struct("speaker", "start_ms", "text")
    s = segments.withColumns({"before": F.collect_list(x).over(w.rowsBetween(-reach, -1)), "after": F.collect_list(x).over(w.rowsBetween(1, reach))})
    return s.where(~is_blank(F.col("text"))).select(*E, "segment_id", "before", "after")
