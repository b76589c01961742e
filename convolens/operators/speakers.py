"""Who speaks how much, when and after whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from convolens.functions.numbers import ratio
from convolens.functions.text import count_words

E = ["show", "episode_id"]


def _share(value: str, over: str):
    return F.round(ratio(F.col(value) * 100, F.col(over)), 2)


def speaker_stats(segments: DataFrame) -> DataFrame:
    """Per episode and speaker: segments, words, seconds, averages, shares, first and last appearance, rank by words."""
    s = segments.select(*E, "segment_id", "speaker", "start_ms", "end_ms", count_words(F.col("text")).alias("words"), F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)).alias("ms"))
    g = s.groupBy(*E, "speaker").agg(F.count("*").alias("n_segments"), F.sum("words").alias("n_words"), F.sum("ms").alias("total_ms"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.min("segment_id").alias("first_segment"))
    w = W.partitionBy(*E)
    g = g.withColumns({"_w": F.sum("n_words").over(w), "_t": F.sum("total_ms").over(w), "_s": F.sum("n_segments").over(w), "word_rank": F.row_number().over(w.orderBy(F.desc("n_words"), "first_segment", "speaker"))})
    return g.select(
        *E, "speaker", "n_segments", "n_words", "total_ms", F.round(ratio(F.col("n_words"), F.col("n_segments")), 2).alias("avg_words"), (F.round(ratio(F.col("total_ms"), F.col("n_segments")), 0) / 1000).alias("avg_seconds"),
        _share("n_words", "_w").alias("word_pct"), _share("total_ms", "_t").alias("time_pct"), _share("n_segments", "_s").alias("segment_pct"), "first_ms", "last_ms", "word_rank",
    )


def episode_stats(segments: DataFrame) -> DataFrame:
    """Per episode: segments, words, seconds, speakers, the dominant one, and derived densities."""
    s = speaker_stats(segments)
    return s.groupBy(*E).agg(
        F.sum("n_segments").alias("n_segments"), F.sum("n_words").alias("n_words"), F.sum("total_ms").alias("total_ms"), F.max("last_ms").alias("end_ms"), F.count("*").alias("n_speakers"),
        F.count_if(F.col("speaker") != "UNKNOWN").alias("n_known_speakers"), F.max(F.when(F.col("word_rank") == 1, F.col("speaker"))).alias("dominant_speaker"), F.round(F.max(F.when(F.col("word_rank") == 1, F.col("word_pct"))), 2).alias("dominant_pct"),
    )


def corpus_summary(segments: DataFrame) -> DataFrame:
    """Per show and for the corpus (show null): episodes, sums, averages, distinct speakers, most common speaker count."""
    ep = episode_stats(segments)
    sums = ep.rollup("show").agg(
        F.grouping("show").alias("is_total"), F.count("*").alias("n_episodes"), F.sum("n_segments").alias("n_segments"), F.sum("n_words").alias("n_words"), F.round(F.sum("total_ms") / 3600000, 2).alias("hours"),
        F.round(F.avg("total_ms") / 60000, 2).alias("avg_minutes"), F.round(F.avg("n_speakers"), 2).alias("avg_speakers"),
    )
    names = segments.select("show", "speaker").distinct().rollup("show").agg(F.grouping("show").alias("is_total"), F.countDistinct("speaker").alias("n_speakers"))
    # the most common count, of ties the smallest: by show, and over all shows
    both = ep.groupBy("show", "n_speakers").agg(F.count("*").alias("n"))
    total = both.groupBy("n_speakers").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("show"), F.lit(1).alias("is_total"), "n_speakers", "n")
    mode = both.select("show", F.lit(0).alias("is_total"), "n_speakers", "n").unionByName(total).groupBy("show", "is_total").agg(F.max_by("n_speakers", F.struct("n", -F.col("n_speakers"))).alias("mode_speakers"))
    key = lambda a, b: a["show"].eqNullSafe(b["show"]) & (a["is_total"] == b["is_total"])
    j = sums.join(names, key(sums, names)).select(sums["*"], names["n_speakers"])
    j = j.join(mode, key(j, mode)).select(j["*"], mode["mode_speakers"])
    return j


def podcast_totals(segments: DataFrame) -> DataFrame:
    """Per show and in total: episodes, segments, words and minutes, and averages per episode."""
    ep = episode_stats(segments)
    g = ep.rollup("show").agg(F.grouping("show").alias("is_total"), F.count("*").alias("n_episodes"), F.sum("n_segments").alias("n_segments"), F.sum("n_words").alias("n_words"), F.sum("total_ms").alias("total_ms"))
    return g.withColumns({"avg_segments": F.round(F.col("n_segments") / F.col("n_episodes"), 2), "avg_words": F.round(F.col("n_words") / F.col("n_episodes"), 2)})


def speakers_of_show(segments: DataFrame, top: int = 15) -> DataFrame:
    """The speakers in most episodes of each show, with the share of its episodes."""
    n = segments.groupBy("show").agg(F.countDistinct("episode_id").alias("all"))
    g = segments.groupBy("show", "speaker").agg(F.countDistinct("episode_id").alias("n_episodes"))
    g = g.withColumn("rank", F.row_number().over(W.partitionBy("show").orderBy(F.desc("n_episodes"), "speaker"))).where(f"rank <= {top}")
    return g.join(n, "show").select("show", "speaker", "n_episodes", "rank", F.round(F.col("n_episodes") * 100 / F.col("all"), 2).alias("episode_pct"))


def speaker_interactions(segments: DataFrame) -> DataFrame:
    """Per episode and speaker: share of words, segments counted as turns, words a turn."""
    g = segments.groupBy(*E, "speaker").agg(F.sum(count_words(F.col("text"))).alias("n_words"), F.count("*").alias("n_turns"))
    total = F.sum("n_words").over(W.partitionBy(*E))
    return g.select(*E, "speaker", "n_words", "n_turns", F.round(ratio(F.col("n_words") * 100, total), 2).alias("word_pct"), F.round(ratio(F.col("n_words"), F.col("n_turns")), 2).alias("words_per_turn"))


def transitions(segments: DataFrame) -> DataFrame:
    """(episode, from, to): how often one speaker follows another, and its share of the speaker's hand-overs."""
    p = segments.select(*E, F.lag("speaker").over(W.partitionBy(*E).orderBy("segment_id")).alias("from_speaker"), F.col("speaker").alias("to_speaker"))
    g = p.where("from_speaker is not null and from_speaker != to_speaker").groupBy(*E, "from_speaker", "to_speaker").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy(*E, "from_speaker")), 2))


def speaking_ranks(segments: DataFrame) -> DataFrame:
    """0-based rank of each speaker by speaking time in the episode; of ties the one who spoke first."""
    g = segments.groupBy(*E, "speaker").agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("time_ms"), F.min("segment_id").alias("first_segment"), F.count("*").alias("n_segments"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy(*E).orderBy(F.desc("time_ms"), "first_segment", "speaker")) - 1)


def host_candidates(segments: DataFrame) -> DataFrame:
    """Per show the speaking-time rank (0 to 3) that looks like the host's, by presence and consistency.

    presence: share of the show's episodes that have the rank (halved below 0.7); consistency: 1 - stdev / mean of its
    times, at least 0, and 0 for a single episode. The candidate has the best score (of ties the lowest rank), occurs
    in min(3, episodes) episodes or more, and is of rank 2 at most.
    """
    r = speaking_ranks(segments)
    n = r.groupBy("show").agg(F.countDistinct("episode_id").alias("n_episodes"))
    # times in seconds, summed as whole milliseconds, so that every engine gets the same digits
    g = r.where("rank <= 3").groupBy("show", "rank").agg(F.count("*").alias("k"), F.avg(F.col("time_ms") / 1000).alias("mean_s"), F.stddev_samp(F.col("time_ms") / 1000).alias("sd_s"))
    g = g.join(n, "show")
    presence = F.col("k") / F.col("n_episodes")
    consistency = F.when(F.col("k") >= 2, F.greatest(F.lit(0.0), 1 - ratio(F.col("sd_s"), F.col("mean_s")))).otherwise(F.lit(0.0))
    score = presence * F.when(presence < 0.7, F.lit(0.5)).otherwise(F.lit(1.0)) * (0.5 + 0.5 * consistency)
    g = g.withColumn("score", F.round(score, 6)).where("mean_s > 0")
    best = g.withColumn("_b", F.row_number().over(W.partitionBy("show").orderBy(F.desc("score"), "rank"))).where("_b = 1 and k >= least(3, n_episodes) and rank <= 2")
    return best.select("show", "rank", "k", "n_episodes", F.round("mean_s", 3).alias("mean_seconds"), "score")


def next_different_speaker(segments: DataFrame, reach: int = 4) -> DataFrame:
    """The first other speaker within the next ``reach`` segments of each segment."""
    ahead = W.partitionBy(*E).orderBy("segment_id").rowsBetween(1, reach)
    s = segments.withColumn("_next", F.collect_list("speaker").over(ahead))
    return s.select(*E, "segment_id", "speaker", F.try_element_at(F.filter("_next", lambda x: x != F.col("speaker")), F.lit(1)).alias("next_speaker"))


def first_appearance(segments: DataFrame) -> DataFrame:
    """Speakers of each episode in order of their first segment."""
    g = segments.groupBy(*E, "speaker").agg(F.min("segment_id").alias("first_segment"))
    return g.withColumn("ord", F.row_number().over(W.partitionBy(*E).orderBy("first_segment", "speaker")))


def appearances(segments: DataFrame) -> DataFrame:
    """Speakers of each episode in order of their first segment, with the times of their first and last words."""
    g = segments.groupBy(*E, "speaker").agg(F.min("segment_id").alias("first_segment"), F.max("segment_id").alias("last_segment"), F.min_by("start_ms", "segment_id").alias("first_ms"), F.max_by("end_ms", "segment_id").alias("last_ms"))
    return g.withColumn("ord", F.row_number().over(W.partitionBy(*E).orderBy("first_segment", "speaker")))
