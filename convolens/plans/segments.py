"""Queries that merge segments, attach speakers and show context."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.operators import merge as M, segments as B
from convolens.plans.base import SEG, TURNS, seg, turns

QUERIES, ORACLE = {}, {}

QUERIES["valid_segments"] = lambda spark, d: B.valid_segments(seg(spark, d)).select("episode_id", "segment_id", "start_ms", "end_ms")
ORACLE["valid_segments"] = f"""WITH {SEG} SELECT episode_id, segment_id, start_ms, end_ms FROM seg WHERE start_ms >= 0 AND end_ms >= start_ms"""

_RUN = f"""{SEG},
f AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY episode_id ORDER BY segment_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f)"""
QUERIES["merge_consecutive"] = lambda spark, d: M.merge_consecutive(seg(spark, d))
ORACLE["merge_consecutive"] = f"""WITH {_RUN}
SELECT "show", episode_id, run, speaker, min(segment_id) AS first_segment, count(*) AS n_segments, arg_min(start_ms, segment_id) AS start_ms, arg_max(end_ms, segment_id) AS end_ms,
  string_agg(text, ' ' ORDER BY segment_id) AS text FROM r GROUP BY "show", episode_id, run, speaker"""

QUERIES["merge_reduction"] = lambda spark, d: M.merge_reduction(seg(spark, d))
ORACLE["merge_reduction"] = f"""WITH {_RUN}
SELECT "show", episode_id, count(*) AS original, sum(new) AS combined, count(*) - sum(new) AS reduction, round((count(*) - sum(new)) * 100 / count(*), 2) AS reduction_pct FROM r GROUP BY "show", episode_id"""

QUERIES["text_with_speakers"] = lambda spark, d: M.text_with_speakers(seg(spark, d))
ORACLE["text_with_speakers"] = f"""WITH {SEG}
SELECT "show", episode_id, string_agg('[' || speaker || ']: ' || text, chr(10) || chr(10) ORDER BY segment_id) AS text FROM seg WHERE text <> '' GROUP BY "show", episode_id"""

_OV = f"""{SEG}, {TURNS},
j AS (SELECT s.episode_id, s.segment_id, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS ov, t.turn_ord, t.speaker_id
      FROM seg s JOIN tur t ON s.episode_id = t.episode_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms AND s.end_ms > s.start_ms),
b AS (SELECT *, row_number() OVER (PARTITION BY episode_id, segment_id ORDER BY ov DESC, turn_ord) AS r FROM j),
o AS (SELECT s.*, b.ov, b.speaker_id FROM seg s LEFT JOIN b ON s.episode_id = b.episode_id AND s.segment_id = b.segment_id AND b.r = 1)"""
QUERIES["interval_overlap_speaker"] = lambda spark, d: M.overlap_speakers(seg(spark, d), turns(spark, d))
ORACLE["interval_overlap_speaker"] = f"""WITH {_OV}
SELECT episode_id, segment_id, CASE WHEN ov * 10 >= end_ms - start_ms THEN speaker_id ELSE 'UNKNOWN' END AS speaker, coalesce(ov, 0) AS overlap_ms FROM o"""

QUERIES["combined_transcripts"] = lambda spark, d: M.combine_with_turns(seg(spark, d), turns(spark, d)).select("show", "episode_id", "segment_id", "speaker", "diarization_applied")
ORACLE["combined_transcripts"] = f"""WITH {_OV}
SELECT "show", episode_id, segment_id, CASE WHEN ov * 10 >= end_ms - start_ms THEN speaker_id ELSE 'UNKNOWN' END AS speaker, true AS diarization_applied
FROM o WHERE episode_id IN (SELECT episode_id FROM tur)"""

QUERIES["episodes_without_turns"] = lambda spark, d: M.episodes_without_turns(seg(spark, d), turns(spark, d))
ORACLE["episodes_without_turns"] = f"""WITH {SEG}, {TURNS} SELECT DISTINCT "show", episode_id FROM seg WHERE episode_id NOT IN (SELECT episode_id FROM tur)"""


def _names(spark, d):
    s = seg(spark, d).where("speaker_name is not null and speaker != 'UNKNOWN'")
    return s.groupBy("episode_id", "speaker").agg(F.min("speaker_name").alias("name"))


QUERIES["apply_labels"] = lambda spark, d: M.apply_labels(seg(spark, d), _names(spark, d)).select("episode_id", "segment_id", "speaker", "speaker_name")
ORACLE["apply_labels"] = f"""WITH {SEG}, m AS (SELECT episode_id, speaker, min(speaker_name) AS name FROM seg WHERE speaker_name IS NOT NULL AND speaker <> 'UNKNOWN' GROUP BY ALL)
SELECT s.episode_id, s.segment_id, s.speaker, coalesce(m.name, s.speaker) AS speaker_name FROM seg s LEFT JOIN m ON s.episode_id = m.episode_id AND s.speaker = m.speaker"""

QUERIES["context_window"] = lambda spark, d: M.context_window(seg(spark, d)).select("show", "episode_id", "segment_id", F.transform("before", lambda x: F.concat_ws("|", x["speaker"], x["start_ms"].cast("string"), x["text"])).alias("before"), F.transform("after", lambda x: F.concat_ws("|", x["speaker"], x["start_ms"].cast("string"), x["text"])).alias("after"))
ORACLE["context_window"] = f"""WITH {SEG}, l AS (SELECT *, speaker || '|' || start_ms || '|' || text AS x FROM seg),
w AS (SELECT *, coalesce(list(x) OVER (PARTITION BY episode_id ORDER BY segment_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS before,
  coalesce(list(x) OVER (PARTITION BY episode_id ORDER BY segment_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS after FROM l)
SELECT "show", episode_id, segment_id, before, after FROM w WHERE regexp_matches(text, '[^\\x09-\\x0D\\x1C-\\x20\\x85\\pZ]')"""

QUERIES["utterance_context"] = lambda spark, d: M.utterance_context(seg(spark, d), seg(spark, d).where("text like '%bread%'"))
ORACLE["utterance_context"] = f"""WITH {SEG}, h AS (SELECT DISTINCT episode_id, segment_id AS hit_id FROM seg WHERE text LIKE '%bread%')
SELECT s.episode_id, h.hit_id, s.segment_id, s.segment_id - h.hit_id AS "offset", s.speaker, s.text FROM h JOIN seg s ON s.episode_id = h.episode_id AND s.segment_id BETWEEN h.hit_id - 2 AND h.hit_id + 2"""
