"""Counts over the sequence of episodes, trends, batches, concurrency and session metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from convolens.functions.numbers import ratio


def counts_by_episode(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(show, episode_id, n) for every episode, 0 where it has none."""
    return episodes.select("show", "episode_id").distinct().join(facts.groupBy("episode_id").agg(F.count("*").alias("n")), "episode_id", "left").fillna(0, ["n"]).select("show", "episode_id", "n")


def trend(counts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first, last, change_pct, direction): sums of the first quarter (rounded down) and the last (rounded up) of the sequence.

    Changes beyond 20 per cent either way are 'increasing' or 'decreasing'; a first quarter of 0 counts as a change of
    100 if the last isn't 0.
    """
    w = W.partitionBy(key)
    c = counts.withColumns({"_r": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    first, last = F.col("_r") <= F.floor(F.col("_n") / 4), F.col("_r") > F.col("_n") - F.ceil(F.col("_n") / 4)
    g = c.groupBy(key).agg(F.coalesce(F.sum(F.when(first, F.col(value))), F.lit(0)).alias("first"), F.coalesce(F.sum(F.when(last, F.col(value))), F.lit(0)).alias("last"))
    change = F.when(F.col("first") != 0, F.round((F.col("last") - F.col("first")) * 100 / F.col("first"), 2)).when(F.col("last") != 0, F.lit(100.0)).otherwise(F.lit(0.0))
    g = g.withColumn("change_pct", change)
    return g.withColumn("direction", F.when(F.col("change_pct") > 20, "increasing").when(F.col("change_pct") < -20, "decreasing").otherwise("stable"))


def sampled(counts: DataFrame, key: str, order: str, points: int = 20) -> DataFrame:
    """Every step-th value of each sequence, the step being a twentieth of its length (at least 1)."""
    w = W.partitionBy(key)
    c = counts.withColumns({"_r": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return c.where(F.col("_r") % F.greatest(F.floor(F.col("_n") / points), F.lit(1)) == 0).drop("_r", "_n")


def duration_batches(files: DataFrame, key: str, duration: str, size: int) -> DataFrame:
    """(key, batch): items in order of duration, ``size`` to a batch, inside each partition key of the frame."""
    r = F.row_number().over(W.partitionBy("show").orderBy(duration, key))
    return files.withColumn("batch", F.floor((r - 1) / size).cast("int"))


def peak_concurrency(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, peak): the most spans open at once; an end at the same time as a start comes first."""
    e = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.*")
    # one row a moment: what ends and starts then
    m = e.groupBy(key, "t").agg(F.sum(F.when(F.col("d") < 0, F.col("d")).otherwise(0)).alias("out"), F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).alias("into"))
    run = F.sum(F.col("into") + F.col("out")).over(W.partitionBy(key).orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return m.withColumn("open", run).groupBy(key).agg(F.greatest(F.max("open"), F.lit(0)).alias("peak"))


def session_metrics(log: DataFrame) -> DataFrame:
    """One row per session of a log (session, ok, bytes, seconds): items, success rate, bytes, bytes a second."""
    g = log.groupBy("session").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))
    return g.select("session", "n", "n_ok", F.round(ratio(F.col("n_ok") * 100, F.col("n")), 2).alias("success_pct"), "bytes", F.round(ratio(F.col("bytes"), F.col("seconds")), 2).alias("bytes_per_second"), F.round(ratio(F.col("n") * 60, F.col("seconds")), 4).alias("items_per_minute"))


def eta_seconds(done, total, seconds):
    """Seconds that the remaining items take at the rate so far."""
    return F.coalesce(F.try_divide((total - done) * seconds, done), F.lit(0.0))


def rolling_average(samples: DataFrame, key: str, order: list[str], value: str, width: int = 100) -> DataFrame:
    """Adds the mean of the last ``width`` samples."""
    return samples.withColumn("rolling", F.avg(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(-(width - 1), 0)))
