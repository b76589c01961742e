"""Conversation features per episode: turn-taking, vocabulary, questions, politeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from convolens.functions import text as T
from convolens.functions.numbers import ratio

E = ["show", "episode_id"]


def _turns(segments: DataFrame) -> DataFrame:
    w = W.partitionBy(*E).orderBy("segment_id")
    return segments.withColumn("_turn", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1)))


def turn_taking_by_speaker(segments: DataFrame) -> DataFrame:
    """Per speaker: turns (changes of speaker), speaking time, seconds a turn."""
    g = _turns(segments).groupBy(*E, "speaker").agg(F.sum("_turn").alias("turns"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("time_ms"))
    return g.withColumn("avg_turn_seconds", F.round(ratio(F.col("time_ms") * 10, F.col("turns")), 0) / 10000)


def turn_taking(segments: DataFrame) -> DataFrame:
    """Per episode: turns, minutes between changes, and how far the longest speaker leads the second.

    The duration is the end of the last segment, not the latest end.
    """
    by = turn_taking_by_speaker(segments)
    top = by.groupBy(*E).agg(F.slice(F.sort_array(F.collect_list("time_ms"), asc=False), 1, 2).alias("t"), F.sum("turns").alias("total_turns"), F.count("*").alias("n_speakers"))
    last = segments.groupBy(*E).agg(F.max_by("end_ms", "segment_id").alias("duration_ms"))
    j = top.join(last, E)
    lead = F.when(F.col("n_speakers") == 1, F.lit(1.0)).otherwise(ratio(F.col("t")[0] - F.try_element_at("t", F.lit(2)), F.col("duration_ms")))
    return j.select(*E, "total_turns", "n_speakers", (F.round(F.col("duration_ms") / 600, 0) / 100).alias("duration_minutes"), (F.round(ratio(F.col("duration_ms"), F.col("total_turns") * 6), 0) / 10000).alias("avg_switch_minutes"), F.round(lead, 4).alias("dominance_index"))


def _words(segments: DataFrame) -> DataFrame:
    return segments.select(*E, "speaker", F.explode(T.vocabulary_words(F.col("text"))).alias("word")).withColumn("content", ~F.col("word").isin(*T.STOPWORDS))


def _counted(words: DataFrame, keys: list[str]) -> DataFrame:
    # counts by word first: distinct counts need no second look at the words, and hot words shrink before the shuffle
    by = words.groupBy(*keys, "word", "content").agg(F.count("*").alias("n"))
    return by.groupBy(*keys).agg(F.sum("n").alias("total_words"), F.count("*").alias("unique_words"), F.coalesce(F.sum(F.when(F.col("content"), F.col("n"))), F.lit(0)).alias("total_words_no_stopwords"), F.count_if("content").alias("unique_words_no_stopwords"), F.count_if(F.col("n") == 1).alias("hapax"))


def vocabulary(segments: DataFrame) -> DataFrame:
    """Per episode: words, different words, both without stop words, type-token ratios, share of words used once."""
    none = segments.select(*E).distinct()
    g = none.join(_counted(_words(segments), E), E, "left").fillna(0)
    n, u = F.col("total_words"), F.col("unique_words")
    return g.select(*E, "total_words", "unique_words", "total_words_no_stopwords", "unique_words_no_stopwords", F.round(ratio(u, n), 4).alias("type_token_ratio"), F.round(ratio(u, F.sqrt(n)), 4).alias("root_type_token_ratio"), F.round(ratio(F.col("hapax"), u), 4).alias("hapax_ratio"))


def vocabulary_by_speaker(segments: DataFrame) -> DataFrame:
    g = _counted(_words(segments), [*E, "speaker"])
    return g.select(*E, "speaker", "total_words", "unique_words", F.round(ratio(F.col("unique_words"), F.col("total_words")), 4).alias("type_token_ratio"))


def episode_text(segments: DataFrame) -> DataFrame:
    """The segments' texts of each episode joined by a space."""
    g = segments.groupBy(*E).agg(F.array_sort(F.collect_list(F.struct("segment_id", "text"))).alias("x"), F.max_by("end_ms", "segment_id").alias("duration_ms"))
    return g.select(*E, "duration_ms", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))


def question_stats(segments: DataFrame) -> DataFrame:
    """Per episode: sentences, questions, their share and rate, and how many address somebody."""
    s = episode_text(segments).select(*E, "duration_ms", T.sentences(F.col("text")).alias("s"))
    q = F.filter("s", T.is_question)
    g = s.select(*E, "duration_ms", F.size("s").cast("bigint").alias("total_sentences"), F.size(q).cast("bigint").alias("total_questions"), F.size(F.filter(q, T.is_direct_address)).cast("bigint").alias("direct_address_count"))
    return g.select(*E, "total_sentences", "total_questions", F.round(ratio(F.col("total_questions"), F.col("total_sentences")), 4).alias("question_ratio"), F.round(ratio(F.col("total_questions") * 60000, F.col("duration_ms")), 4).alias("questions_per_minute"), "direct_address_count", F.round(ratio(F.col("direct_address_count"), F.col("total_questions")), 4).alias("direct_address_ratio"))


def questions(segments: DataFrame) -> DataFrame:
    """(episode, question_no, question) of each episode's text."""
    s = episode_text(segments).select(*E, F.filter(T.sentences(F.col("text")), T.is_question).alias("q"))
    return s.select(*E, F.posexplode("q").alias("question_no", "question"))


def best_segments(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """(episode, question_no, segment_id, speaker, common): the segment that shares most different words with a question.

    A hash join on (episode, word) instead of comparing every question with every segment; of ties the first segment.
    """
    q = asked.select(*E, "question_no", F.explode(F.array_distinct(F.filter(F.split(T.normalized(F.col("question")), " "), lambda w: w != ""))).alias("word"))
    s = segments.select(*E, "segment_id", F.explode(F.array_distinct(F.filter(F.split(T.normalized(F.col("text")), " "), lambda w: w != ""))).alias("word"))
    n = q.join(s, [*E, "word"]).groupBy(*E, "question_no", "segment_id").agg(F.count("*").alias("common"))
    best = n.groupBy(*E, "question_no").agg(F.max(F.struct("common", (-F.col("segment_id")).alias("s"))).alias("b")).select(*E, "question_no", "b.common", (-F.col("b.s")).alias("segment_id"))
    return best.join(segments.select(*E, "segment_id", "speaker"), [*E, "segment_id"]).select(*E, "question_no", "segment_id", "speaker", "common")


def questions_by_speaker(segments: DataFrame) -> DataFrame:
    return best_segments(segments, questions(segments)).groupBy(*E, "speaker").agg(F.count("*").alias("n_questions"))


def politeness(segments: DataFrame) -> DataFrame:
    """Per episode: mean politeness of its segments that say something."""
    g = segments.where(~T.is_blank(F.col("text"))).select(*E, T.politeness_score(F.col("text")).alias("p")).groupBy(*E).agg(F.count("*").alias("n_analyzed"), F.round(F.avg("p"), 4).alias("average_politeness"))
    return segments.select(*E).distinct().join(g, E, "left").fillna(0)


def politeness_by_speaker(segments: DataFrame) -> DataFrame:
    g = segments.where(~T.is_blank(F.col("text"))).select(*E, "speaker", T.politeness_score(F.col("text")).alias("p"))
    return g.groupBy(*E, "speaker").agg(F.round(F.avg("p"), 4).alias("average_politeness"))


def politeness_strategies(segments: DataFrame) -> DataFrame:
    """(episode, strategy, n): how many segments show each strategy."""
    seen = F.array(*(F.when(c, F.lit(k)) for k, c in T.politeness_strategies(F.col("text")).items()))
    s = segments.where(~T.is_blank(F.col("text"))).select(*E, F.explode(F.filter(seen, lambda x: x.isNotNull())).alias("strategy"))
    return s.groupBy(*E, "strategy").agg(F.count("*").alias("n"))


def episode_features(segments: DataFrame) -> DataFrame:
    """All feature groups of each episode in one row."""
    q, t, v, p = question_stats(segments), turn_taking(segments), vocabulary(segments), politeness(segments)
    return q.join(t, E).join(v, E).join(p, E)


def features_long(segments: DataFrame) -> DataFrame:
    """(episode, speaker, metric, value): the per-speaker features as rows, the source of any wide table."""
    t = turn_taking_by_speaker(segments).select(*E, "speaker", F.expr("stack(3, 'turns', cast(turns as double), 'speaking_time', time_ms / 1000, 'avg_turn_time', avg_turn_seconds) as (metric, value)"))
    v = vocabulary_by_speaker(segments).select(*E, "speaker", F.expr("stack(3, 'words', cast(total_words as double), 'unique_words', cast(unique_words as double), 'ttr', type_token_ratio) as (metric, value)"))
    p = politeness_by_speaker(segments).select(*E, "speaker", F.lit("politeness").alias("metric"), F.col("average_politeness").alias("value"))
    q = questions_by_speaker(segments).select(*E, "speaker", F.lit("questions").alias("metric"), F.col("n_questions").cast("double").alias("value"))
    return t.unionByName(v).unionByName(p).unionByName(q)
