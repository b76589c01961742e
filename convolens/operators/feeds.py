"""Episodes of feeds: clean-up, identity, filters, ranking and the store of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convolens.functions.numbers import ratio


def current_episodes(episodes: DataFrame) -> DataFrame:
    """One row per episode_id: the latest fetch, of ties the greatest values."""
    cols = [c for c in episodes.columns if c not in ("episode_id", "fetched_at")]
    g = episodes.groupBy("episode_id").agg(F.max(F.struct("fetched_at", *cols)).alias("r"))
    return g.select("episode_id", *(F.col(f"r.{c}") for c in cols), "r.fetched_at")


def episode_key(guid: Column, url: Column, title: Column, link: Column) -> Column:
    """The guid, or the first 16 hexadecimal digits of the SHA-256 of url:title:link."""
    return F.coalesce(F.nullif(guid, F.lit("")), F.left(F.sha2(F.concat_ws(":", url, title, link), 256), F.lit(16)))


def is_audio(url: Column, mime: Column) -> Column:
    return F.coalesce(mime.startswith("audio/"), F.lit(False)) | F.coalesce(F.lower(url).rlike(r"\.(?:mp3|m4a|ogg|wav)(?:[?#]|$)"), F.lit(False))


def filter_episodes(episodes: DataFrame, start: str | None = None, end: str | None = None, newest: int | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Episodes published in [start, end] (undated ones go once a bound is set), then the newest, or a seeded sample."""
    e = episodes
    if start is not None:
        e = e.where(F.col("published") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        e = e.where(F.col("published") <= F.lit(end).cast("timestamp_ntz"))
    if sample is not None:
        return e.orderBy(F.xxhash64(F.lit(seed), F.col("episode_id")), "episode_id").limit(sample)
    return e if newest is None else e.orderBy(F.desc_nulls_last("published"), "episode_id").limit(newest)


def long_enough(episodes: DataFrame, least: int) -> DataFrame:
    """Episodes of at least ``least`` seconds or of unknown length."""
    return episodes.where(F.col("duration").isNull() | (F.col("duration") >= least))


def too_small(episodes: DataFrame, least_kb: int) -> DataFrame:
    return episodes.where(F.col("file_size") < least_kb * 1024)


def distinct_feeds(feeds: DataFrame, order: str) -> DataFrame:
    """One row per feed_url: the first by ``order``."""
    return feeds.withColumn("_r", F.row_number().over(W.partitionBy("feed_url").orderBy(order))).where("_r = 1").drop("_r")


def popular(shows: DataFrame, value: str, n: int, most: int = 50) -> DataFrame:
    return shows.orderBy(F.desc(value), "show").limit(min(n, most))


def find_podcast(shows: DataFrame, query: str) -> DataFrame:
    """Shows whose title contains the query or is contained in it."""
    q = query.lower()
    return shows.where(F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lit(q), F.lower("title")))


def rank_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds (title, provider, confidence, fuzzy, n_episodes) by blended score; the best of each query has rank 1."""
    blend = F.round(0.5 * F.col("confidence") + 0.5 * F.col("fuzzy"), 6)
    best = F.round(0.4 * F.col("confidence") + 0.4 * F.col("fuzzy") + F.least(F.col("n_episodes") / 1000, F.lit(0.2)), 6)
    f = feeds.withColumns({"blend": blend, "score": best})
    return f.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "title")))


def store_statistics(episodes: DataFrame) -> DataFrame:
    """Podcasts, episodes and bytes in the store."""
    return episodes.agg(F.countDistinct("show").alias("n_podcasts"), F.count("*").alias("n_episodes"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def not_stored(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    return candidates.join(stored.select("episode_id"), "episode_id", "left_anti")


def folder_sizes(episodes: DataFrame) -> DataFrame:
    """(show, n_files, bytes, mean_bytes) sorted by name."""
    return episodes.groupBy("show").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.round(ratio(F.sum("file_size"), F.count("file_size")), 2).alias("mean_bytes")).orderBy("show")


def in_genre(shows: DataFrame, genre: str, column: str = "genre") -> DataFrame:
    """Shows whose genre contains the wanted one, whatever the case; null genres contain nothing."""
    return shows.where(F.contains(F.lower(column), F.lit(genre.lower())))
