"""Tables to the file layouts others read: transcripts, turns, features, matches, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

E = ["show", "episode_id"]


def write_transcripts(segments: DataFrame, root: str) -> None:
    """One JSON document an episode, its segments in order, in a file of its own in a folder per show and episode; other columns stay as they are."""
    cols = [c for c in segments.columns if c not in E]
    g = segments.groupBy(*E).agg(F.array_sort(F.collect_list(F.struct("segment_id", *(c for c in cols if c != "segment_id")))).alias("segments"))
    g.write.mode("overwrite").partitionBy(*E).json(root)


def rttm_lines(turns: DataFrame) -> DataFrame:
    """RTTM lines of turns (episode_id, start, end, speaker)."""
    return turns.select("episode_id", F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "episode_id", "start", F.col("end") - F.col("start"), "speaker").alias("value"))


#: Small files go to a local folder without a checksum file beside each; it is a second file, and one more process started. Other file systems don't read these.
UNCHECKED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_rttm(turns: DataFrame, root: str) -> None:
    """A file an episode, in a folder of its own; as many tasks as a shuffle has, however few the bytes, for files take the time."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartitionByRange(n, "episode_id").sortWithinPartitions("episode_id", "start")
    rttm_lines(ordered).write.options(**UNCHECKED).mode("overwrite").partitionBy("episode_id").text(root)


def wide_features(features: DataFrame, long: DataFrame, speakers: list[str]) -> DataFrame:
    """Episode features with <metric>_<speaker> columns for the named speakers (a bounded list: columns can't grow with the data)."""
    w = long.where(F.col("speaker").isin(*speakers)).groupBy(*E).pivot("speaker", speakers).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    metrics = ["turns", "speaking_time", "avg_turn_time", "words", "unique_words", "ttr", "politeness", "questions"]
    return features.join(w.select(*E, *(F.try_element_at(F.col(f"`{s}`"), F.lit(m)).alias(f"{m}_{s}") for s in speakers for m in metrics)), E, "left")


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def _enveloped(matches: DataFrame) -> DataFrame:
    """(episode_id, match_count, keyword_counts, matches): the matches of each episode in order, with their counts."""
    m = F.struct("keyword", "matched_text", "context_before", "context_after", "position", "segment_id", "speaker", "start_ms", "category", "tier")
    counts = matches.groupBy("episode_id", "keyword").agg(F.count("*").alias("n")).groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "n")))).alias("keyword_counts"))
    g = matches.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "position", m.alias("m")))).alias("x"), F.count("*").alias("match_count")).join(counts, "episode_id")
    return g.select("episode_id", "match_count", "keyword_counts", F.transform("x", lambda e: e["m"]).alias("matches"))


def matches_envelope(matches: DataFrame) -> DataFrame:
    """(episode_id, json): the matches of each episode with their count and the counts by keyword."""
    return _enveloped(matches).select("episode_id", F.to_json(F.struct("match_count", "keyword_counts", "matches")).alias("json"))


def write_matches(matches: DataFrame, root: str) -> None:
    """The same as files of one JSON line an episode, which has its id too."""
    _enveloped(matches).write.mode("overwrite").json(root)


def episode_export(stats: DataFrame) -> DataFrame:
    """Episode statistics with minutes of two decimals."""
    return stats.select("show", "episode_id", "n_segments", "n_words", "n_speakers", F.round(F.col("total_ms") / 60000, 2).alias("minutes")).orderBy("show", "episode_id")


def match_lines(matches: DataFrame) -> DataFrame:
    """(episode_id, segment_id, position, line): matches as text, one a line."""
    at = F.format_string("[%02d:%02d:%02d]", (F.col("start_ms") / 3600000).cast("int"), (F.col("start_ms") / 60000).cast("int") % 60, (F.col("start_ms") / 1000).cast("int") % 60)
    return matches.select("episode_id", "segment_id", "position", F.concat_ws(" ", at, F.concat("speaker", F.lit(":")), F.concat("context_before", F.lit("["), "matched_text", F.lit("]"), "context_after")).alias("line"))


def nested_features(features: DataFrame, by_speaker: DataFrame) -> DataFrame:
    """(show, episode_id, json): an episode's features with those of its speakers inside, by name."""
    own = [c for c in features.columns if c not in E]
    per = [c for c in by_speaker.columns if c not in (*E, "speaker")]
    s = by_speaker.groupBy(*E).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.struct(*per).alias("v"))))).alias("speakers"))
    return features.join(s, E, "left").select(*E, F.to_json(F.struct(*own, "speakers")).alias("json"))


def category_export(matches: DataFrame) -> DataFrame:
    """(rank, category, n): categories by number of matches, most first, of ties by name."""
    from pyspark.sql import Window as W

    g = matches.groupBy("category").agg(F.count("*").alias("n"))
    return g.select(F.row_number().over(W.orderBy(F.desc("n"), "category")).alias("rank"), "category", "n")


def _element(name: str, value: Column) -> Column:
    """An XML element with escaped text; null if the value is."""
    text = value.cast("string")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    # characters that XML has no way to write are left out
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ufffe\uffff]", "")
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def write_feed(shows: DataFrame, episodes: DataFrame, root: str) -> None:
    """An RSS file a show, in a folder of its own, with an item an episode."""
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), _element("x", value).substr(F.lit(4), F.length(_element("x", value)) - 7), F.lit('"'))
    enclosure = F.concat(F.lit("<enclosure"), F.concat_ws("", attribute("url", F.col("audio_url")), attribute("type", F.col("mime_type")), attribute("length", F.col("file_size"))), F.lit("/>"))
    items = episodes.select("show", F.concat(F.lit("<item>"), F.concat_ws(
        "", _element("guid", F.col("episode_id")), _element("title", F.col("title")), _element("description", F.col("description")), _element("pubDate", F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss +0000")),
        enclosure, _element("itunes:duration", F.col("duration")), _element("itunes:episode", F.col("episode_number")), _element("itunes:season", F.col("season_number")),
    ), F.lit("</item>")).alias("item")).groupBy("show").agg(F.array_sort(F.collect_list("item")).alias("items"))
    head = F.concat_ws("", _element("title", F.col("title")), _element("description", F.col("description")), _element("itunes:author", F.col("author")), _element("link", F.col("website")), _element("language", F.col("language")))
    feeds = shows.join(items, "show", "left").select("show", F.concat(F.lit('<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>'), head, F.concat_ws("", F.coalesce("items", F.expr("cast(array() as array<string>)"))), F.lit("</channel></rss>")).alias("value"))
    feeds.write.mode("overwrite").partitionBy("show").text(root)
