"""Searches over texts, keyword matches and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convolens.functions.text import snippet


def search_texts(segments: DataFrame, pattern: str, shows: list[str] | None = None, limit: int | None = 50) -> DataFrame:
    """Segments that match a regular expression (any case), one hit each, with the text around the first match."""
    s = segments if not shows else segments.where(F.col("show").isin(*shows))
    rx = f"(?iu){pattern}"
    hits = s.where(F.col("text").rlike(rx)).select("show", "episode_id", "segment_id", "speaker", snippet(F.col("text"), rx).alias("context"))
    return hits if limit is None else hits.orderBy("show", "episode_id", "segment_id").limit(limit)


def search_matches(matches: DataFrame, pattern: str, category: str | None = None, limit: int | None = 50) -> DataFrame:
    """Keyword matches whose keyword fits the pattern."""
    m = matches if category is None else matches.where(F.lower("category") == category.lower())
    hits = m.where(F.col("keyword").rlike(f"(?iu){pattern}")).select("show", "episode_id", "segment_id", "keyword", "category", "position")
    return hits if limit is None else hits.orderBy("show", "episode_id", "segment_id", "keyword", "position").limit(limit)


def search_annotations(ann: DataFrame, pattern: str, has_hate: bool | None = None, limit: int | None = 50) -> DataFrame:
    """Annotations whose topic or target group fits; has_hate is a null-safe flag, so missing is not false."""
    a = ann if has_hate is None else ann.where(F.col("has_hate_speech").eqNullSafe(F.lit(has_hate)))
    rx = f"(?iu){pattern}"
    hits = a.where(F.coalesce(F.col("main_topic").rlike(rx), F.lit(False)) | F.coalesce(F.col("target_group").rlike(rx), F.lit(False))).select("source", "episode_id", "doc_id", "main_topic", "target_group")
    return hits if limit is None else hits.orderBy("doc_id").limit(limit)


def global_search(segments: DataFrame, matches: DataFrame, ann: DataFrame, pattern: str, cap: int = 50) -> DataFrame:
    """(kind, show, n): hits of all three searches, at most ``cap`` of each kind, by show."""
    parts = (
        search_texts(segments, pattern, limit=cap).select(F.lit("transcript").alias("kind"), "show"),
        search_matches(matches, pattern, limit=cap).select(F.lit("keyword").alias("kind"), "show"),
        search_annotations(ann, pattern, limit=cap).select(F.lit("annotation").alias("kind"), F.col("source").alias("show")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "show").agg(F.count("*").alias("n"))
