"""Keyword matches with their places, and statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from convolens.functions import text as T
from convolens.functions.numbers import ratio


def distinct_keywords(lexicon: DataFrame) -> DataFrame:
    """Each keyword once, whatever its case: the entry of lowest order holds."""
    k = lexicon.where("keyword is not null").withColumn("_r", F.row_number().over(W.partitionBy(F.lower("keyword")).orderBy("ord")))
    return k.where("_r = 1").drop("_r")


def keyword_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Category and tier of each word: the first entry by category order, high confidence before exploratory."""
    first = lexicon.where("keyword is not null").withColumn("_r", F.row_number().over(W.partitionBy(F.lower("keyword")).orderBy(F.col("tier") != "high_confidence", "ord"))).where("_r = 1")
    return words.join(F.broadcast(first.select(F.lower("keyword").alias("_k"), "category", "tier")), F.lower(F.col("word")) == F.col("_k"), "left").drop("_k")


def keyword_matches(segments: DataFrame, lexicon: DataFrame, window: int = 50, partial: bool = False, least_length: int = 2) -> DataFrame:
    """Every non-overlapping match of every keyword: its text, position, and ``window`` characters on both sides.

    A segment is scanned only for the keywords whose first word is among its own words (a hash join; with ``partial``
    a substring test); each keyword scans alone, so keywords may overlap. The lexicon is a fixed dimension, broadcast.
    """
    cut = r"[^\p{L}\p{N}\p{M}_]+"
    lex = distinct_keywords(lexicon).where(F.length("keyword") >= least_length).select("ord", "keyword", "category", "tier", F.lower("keyword").alias("_low"))
    s = segments.where("text != ''").select("show", "episode_id", "segment_id", "speaker", "start_ms", "end_ms", "text", F.lower("text").alias("_text"))
    if partial:
        hit = s.join(F.broadcast(lex), F.col("_text").contains(F.col("_low"))).drop("_text", "_low")
    else:
        first = lex.withColumn("_word", F.filter(F.split("_low", cut), lambda w: w != "")[0]).drop("_low")
        # a segment's own words that begin keywords: only segments that have one are taken apart, and only at those
        words = F.array_distinct(F.split("_text", cut))
        starts = F.broadcast(first.agg(F.collect_set("_word").alias("_starts")))
        own = s.join(starts, F.lit(True)).withColumn("_own", F.array_intersect(words, "_starts")).where(F.size("_own") > 0)
        hit = own.withColumn("_word", F.explode("_own")).drop("_text", "_own", "_starts").join(F.broadcast(first), "_word").drop("_word")
    pattern = T.keyword_pattern(F.col("keyword"), partial)
    # the gaps between matches and the matches themselves, in turn, give each match's place
    hit = hit.withColumns({"_m": F.regexp_extract_all("text", pattern, F.lit(0)), "_g": F.split("text", pattern, -1)}).where(F.size("_m") > 0)
    ends = F.aggregate(F.arrays_zip("_g", "_m"), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda a, x: F.struct((a["at"] + F.length(x["_g"]) + F.coalesce(F.length(x["_m"]), F.lit(0))).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(x["_g"]))).alias("out")))
    hit = hit.withColumn("_at", ends["out"]).select("*", F.posexplode("_m").alias("match_no", "matched_text"))
    at = F.element_at("_at", F.col("match_no") + 1)
    return hit.select(
        "show", "episode_id", "segment_id", "speaker", "start_ms", "end_ms", "keyword", "category", "tier", "matched_text", at.alias("position"),
        F.col("text").substr(F.greatest(at - window, F.lit(0)) + 1, F.least(at, F.lit(window))).alias("context_before"), F.col("text").substr(at + F.length("matched_text") + 1, F.lit(window)).alias("context_after"),
    )


def match_statistics(matches: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by keyword, speaker, category and tier (both tiers always) and in total."""
    g = matches.groupingSets([["keyword"], ["speaker"], ["category"], ["tier"], []], "keyword", "speaker", "category", "tier").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    name = F.when(F.col("g") == 7, "keyword").when(F.col("g") == 11, "speaker").when(F.col("g") == 13, "category").when(F.col("g") == 14, "tier").otherwise("total")
    out = g.select(name.alias("dimension"), F.coalesce("keyword", "speaker", "category", "tier", F.lit("all")).alias("value"), "n")
    tiers = out.sparkSession.createDataFrame([("tier", "high_confidence"), ("tier", "exploratory")], "dimension string, value string")
    none = tiers.join(out, ["dimension", "value"], "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    return out.unionByName(none)


def gated_episodes(episodes: DataFrame, matches: DataFrame, least: int = 1) -> DataFrame:
    """Episodes with at least ``least`` matches; without any match the count is 0."""
    if least <= 0:
        return episodes
    enough = matches.groupBy("episode_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return episodes.join(enough, "episode_id", "left_semi")


def keyword_timeline(matches: DataFrame, bins: int = 10) -> DataFrame:
    """(episode_id, bin, n): matches in equal-width bins between the first and the last one of an episode; empty bins are 0."""
    w = W.partitionBy("episode_id")
    m = matches.select("episode_id", "start_ms", F.min("start_ms").over(w).alias("lo"), F.max("start_ms").over(w).alias("hi")).where("hi > lo")
    m = m.withColumn("bin", F.least(F.floor((F.col("start_ms") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int"))
    g = m.groupBy("episode_id", "bin").agg(F.count("*").alias("n"))
    every = g.select("episode_id").distinct().select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(g, ["episode_id", "bin"], "left").fillna(0, ["n"])


def category_statistics(matches: DataFrame) -> DataFrame:
    """Per category: matches, episodes and different keywords."""
    return matches.groupBy("category").agg(F.count("*").alias("n_matches"), F.countDistinct("episode_id").alias("n_episodes"), F.countDistinct("keyword").alias("n_keywords"))


def category_heatmap(matches: DataFrame, shows: int = 10, categories: int = 10) -> DataFrame:
    """(show, category, n, intensity 0 to 3) for the first shows by name and the top categories; missing cells are 0."""
    g = matches.groupBy("show", "category").agg(F.count("*").alias("n"))
    s = g.select("show").distinct().orderBy("show").limit(shows)
    c = g.groupBy("category").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "category").limit(categories).select("category")
    cells = s.join(F.broadcast(c), F.lit(True))
    out = cells.join(g, ["show", "category"], "left").fillna(0, ["n"])
    top = F.max("n").over(W.partitionBy())
    return out.withColumn("intensity", F.least(F.lit(3), F.floor(ratio(F.col("n") * 4, top))).cast("int"))


def keyword_density(matches: DataFrame, segments: DataFrame) -> DataFrame:
    """Per episode: matches, words, matches per 1000 words, different categories."""
    m = matches.groupBy("episode_id").agg(F.count("*").alias("n_matches"), F.countDistinct("category").alias("n_categories"))
    n = segments.groupBy("episode_id").agg(F.sum(T.count_words(F.col("text"))).alias("n_words"))
    return n.join(m, "episode_id", "left").fillna(0).withColumn("match_density", F.round(ratio(F.col("n_matches") * 1000, F.col("n_words")), 4))


def top_keywords(matches: DataFrame, top: int = 10) -> DataFrame:
    return matches.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(top)


def keyword_members(matches: DataFrame, wanted: list[str]) -> DataFrame:
    """Episodes by how many of the wanted keywords (any case) they hold."""
    return matches.where(F.lower("keyword").isin(*[w.lower() for w in wanted])).groupBy("show", "episode_id").agg(F.count("*").alias("n_matches"), F.countDistinct(F.lower("keyword")).alias("n_keywords"))
