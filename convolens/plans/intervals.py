"""Queries on time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convolens.operators.intervals import periods_and_gaps
from convolens.session import table

QUERIES, ORACLE = {}, {}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "turns").select("episode_id", "speaker", "start", "end")
    return periods_and_gaps(turns, ["episode_id", "speaker"])


QUERIES["p2_found"] = p2_found
ORACLE["p2_found"] = """
WITH v AS (
  SELECT episode_id, speaker, CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM turns WHERE episode_id IS NOT NULL AND speaker IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL),
m AS (SELECT *, max(e) OVER (PARTITION BY episode_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM v WHERE e > s),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END)
        OVER (PARTITION BY episode_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
p AS (SELECT episode_id, speaker, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY episode_id, speaker, island),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY episode_id, speaker ORDER BY start_ms) AS nxt FROM p)
SELECT episode_id, speaker, 'period' AS kind, start_ms, end_ms FROM n
UNION ALL SELECT episode_id, speaker, 'gap', end_ms, nxt FROM n WHERE nxt IS NOT NULL
"""
