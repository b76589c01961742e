"""What the plans share: base frames, and the same frames as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convolens.operators import segments as S
from convolens.session import table


def seg(spark: SparkSession, d: str) -> DataFrame:
    return S.current_segments(table(spark, d, "segments"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return S.current_turns(table(spark, d, "turns"))


def cls(spark: SparkSession, d: str) -> DataFrame:
    return S.current_classifications(table(spark, d, "classifications"))


SEG = """seg AS (
  SELECT "show", episode_id, segment_id, coalesce(text, '') AS text, coalesce(nullif(trim(speaker), ''), 'UNKNOWN') AS speaker,
         CAST(round(coalesce("start", 0) * 1000) AS BIGINT) AS start_ms, CAST(round(coalesce("end", 0) * 1000) AS BIGINT) AS end_ms, speaker_name
  FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, segment_id ORDER BY ingested_at DESC NULLS LAST, "start" DESC NULLS LAST, "end" DESC NULLS LAST,
               speaker DESC NULLS LAST, text DESC NULLS LAST, "show" DESC NULLS LAST, speaker_name DESC NULLS LAST) AS r FROM segments) WHERE r = 1)"""

SPACE = r"\x09-\x0D\x1C-\x20\x85\pZ"


def words(col: str) -> str:
    """SQL for the number of white-space separated words."""
    return f"len(regexp_extract_all({col}, '[^{SPACE}]+'))"


TURNS = """tur AS (
  SELECT episode_id, turn_ord, s AS start_ms, e AS end_ms, speaker AS speaker_id FROM (
    SELECT *, row_number() OVER (PARTITION BY episode_id, turn_ord ORDER BY ingested_at DESC NULLS LAST, s DESC, e DESC, speaker DESC) AS r FROM (
      SELECT *, CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e FROM turns) WHERE speaker IS NOT NULL AND e > s) WHERE r = 1)"""

CLS = """cls AS (
  SELECT doc_id, model_name, CASE WHEN lower(trim(label)) IN ('toxic', 'explicit') THEN lower(trim(label)) ELSE upper(trim(label)) END AS label,
         CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, model_name ORDER BY run_at DESC NULLS LAST, label DESC NULLS LAST, confidence DESC NULLS LAST) AS r FROM classifications) WHERE r = 1)"""


def div(a: str, b: str) -> str:
    """SQL for a / b, 0 where b is 0 or null."""
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"
