"""Small derived properties, reports on labelled names, and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convolens.functions.fuzzy import prepared, score_of
from convolens.functions.numbers import ratio
from convolens.functions.text import tokens


def balance_scores(by_speaker: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, balance): 1 less twice the population deviation of the speakers' shares, at least 0; 1 for one speaker, 0 for none."""
    share = ratio(F.col(value), F.sum(value).over(W.partitionBy(*keys)))
    s = by_speaker.select(*keys, share.alias("s"))
    g = s.groupBy(*keys).agg(F.count("*").alias("k"), F.stddev_pop("s").alias("sd"))
    return g.select(*keys, F.when(F.col("k") == 1, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - 2 * F.col("sd")), 4)).alias("balance"))


def first_words(text: Column, n: int = 500) -> Column:
    """The first n words, joined by single spaces: an introduction to look for names in."""
    return F.array_join(F.slice(tokens(text), 1, n), " ")


#: Queries of a lot: a stated set that every target is scored against, and that is sent to all tasks.
QUERIES = 10_000


def _scored(queries: DataFrame, targets: DataFrame) -> DataFrame:
    q = queries.select("query").distinct().withColumn("_q", prepared(F.col("query")))
    if q.limit(QUERIES + 1).count() > QUERIES:
        raise ValueError(f"more than {QUERIES} queries: ask in lots")
    t = targets.select("target").distinct().withColumn("_t", prepared(F.col("target")))
    return t.join(F.broadcast(q), F.lit(True)).select("query", "target", F.round(score_of(F.col("_q"), F.col("_t")), 6).alias("score"))


def best_match(queries: DataFrame, targets: DataFrame, least: float = 0.3) -> DataFrame:
    """(query, target, score): the best target of each query (a small dimension), if its score exceeds ``least``.

    Queries are a stated set of some dozens of rows; every target is scored against all of them.
    """
    s = _scored(queries, targets).where(F.col("score") > least)
    return s.groupBy("query").agg(F.max_by(F.struct("target", "score"), F.struct("score", F.reverse("target"))).alias("b")).select("query", "b.target", "b.score")


def rank_results(queries: DataFrame, targets: DataFrame, top: int = 5) -> DataFrame:
    """(query, rank, target, score): the best targets of each query, of ties the first by name."""
    s = _scored(queries, targets)
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "target"))).where(F.col("rank") <= top)


def episode_metadata(episodes: DataFrame) -> DataFrame:
    """(episode_id, host, guests, source, confidence) of episodes with feed_author, known_host and file_names.

    The feed's author (0.9) goes before the known host (0.8), then the first name in the file's name (0.5), else
    nobody (0.3); guests are the other names in the file's name.
    """
    feed, known, names = F.nullif(F.trim("feed_author"), F.lit("")), F.nullif(F.trim("known_host"), F.lit("")), F.coalesce("file_names", F.expr("cast(array() as array<string>)"))
    first = F.try_element_at(names, F.lit(1))
    host = F.coalesce(feed, known, first)
    source = F.when(feed.isNotNull(), "feed").when(known.isNotNull(), "known_host").when(first.isNotNull(), "filename").otherwise("none")
    conf = F.when(feed.isNotNull(), 0.9).when(known.isNotNull(), 0.8).when(first.isNotNull(), 0.5).otherwise(0.3)
    return episodes.select("episode_id", host.alias("host"), F.filter(names, lambda n: F.coalesce(F.lower(n) != F.lower(host), F.lit(True))).alias("guests"), source.alias("source"), conf.alias("confidence"))


def hosts_of_shows(mapped: DataFrame, episodes: DataFrame) -> DataFrame:
    """(show, name, role, n_episodes): who hosts each show and who visits it."""
    return mapped.where(F.col("role").isin("HOST", "GUEST")).join(episodes.select("episode_id", "show"), "episode_id").groupBy("show", "name", "role").agg(F.countDistinct("episode_id").alias("n_episodes"))


def confidence_buckets(mapped: DataFrame, bins: int = 10) -> DataFrame:
    """(bucket, n): mapped names by confidence; empty buckets are 0."""
    g = mapped.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return mapped.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket")).join(g, "bucket", "left").fillna(0, ["n"])


def compare_episodes(stats: DataFrame, metric: str, most: int = 10) -> DataFrame:
    """The first ``most`` episodes by key with a metric, and its mean over them."""
    first = stats.orderBy("episode_id").limit(most).select("episode_id", F.col(metric).cast("double").alias("value"))
    return first.join(F.broadcast(first.agg(F.round(F.avg("value"), 4).alias("average"))), F.lit(True))


def throughput(log: DataFrame) -> DataFrame:
    """(session, items_per_second, files_per_minute, avg_batch_ms) of a log (session, items, files, batches, ms)."""
    g = log.groupBy("session").agg(*(F.sum(c).alias(c) for c in ("items", "files", "batches", "ms")))
    return g.select("session", F.round(ratio(F.col("items") * 1000, F.col("ms")), 4).alias("items_per_second"), F.round(ratio(F.col("files") * 60000, F.col("ms")), 4).alias("files_per_minute"), F.round(ratio(F.col("ms"), F.col("batches")), 4).alias("avg_batch_ms"))


def stamp(time: Column) -> Column:
    """A time as it stands in file names."""
    return F.date_format(time, "yyyy_MM_dd_HH_mm_ss")


def match_rate(matches: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: episodes, episodes with a match, and their share in per cent."""
    n = segments.agg(F.countDistinct("episode_id").alias("n_episodes"))
    m = matches.agg(F.countDistinct("episode_id").alias("n_matched"))
    return n.join(m, F.lit(True)).withColumn("match_rate", F.round(ratio(F.col("n_matched") * 100, F.col("n_episodes")), 2))
