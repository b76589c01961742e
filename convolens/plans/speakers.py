"""Queries on speakers, episodes and shows."""

from __future__ import annotations

from convolens.operators import speakers as S
from convolens.plans.base import SEG, div, seg, words

QUERIES, ORACLE = {}, {}

_SPK = f"""{SEG},
spk AS (SELECT "show", episode_id, speaker, count(*) AS n_segments, sum({words("text")}) AS n_words, sum(greatest(end_ms - start_ms, 0)) AS total_ms,
  min(start_ms) AS first_ms, max(end_ms) AS last_ms, min(segment_id) AS first_segment FROM seg GROUP BY ALL),
ranked AS (SELECT *, sum(n_words) OVER e AS w, sum(total_ms) OVER e AS t, sum(n_segments) OVER e AS s,
  row_number() OVER (PARTITION BY "show", episode_id ORDER BY n_words DESC, first_segment, speaker) AS word_rank FROM spk WINDOW e AS (PARTITION BY "show", episode_id))"""
_EP = f"""{_SPK},
ep AS (SELECT "show", episode_id, sum(n_segments) AS n_segments, sum(n_words) AS n_words, sum(total_ms) AS total_ms, max(last_ms) AS end_ms, count(*) AS n_speakers,
  count(*) FILTER (speaker <> 'UNKNOWN') AS n_known_speakers, max(CASE WHEN word_rank = 1 THEN speaker END) AS dominant_speaker,
  round(max(CASE WHEN word_rank = 1 THEN round({div("n_words * 100", "w")}, 2) END), 2) AS dominant_pct FROM ranked GROUP BY ALL)"""

QUERIES["speaker_stats"] = lambda spark, d: S.speaker_stats(seg(spark, d))
ORACLE["speaker_stats"] = f"""WITH {_SPK}
SELECT "show", episode_id, speaker, n_segments, n_words, total_ms, round({div("n_words", "n_segments")}, 2) AS avg_words, round({div("total_ms", "n_segments")}, 0) / 1000 AS avg_seconds,
  round({div("n_words * 100", "w")}, 2) AS word_pct, round({div("total_ms * 100", "t")}, 2) AS time_pct, round({div("n_segments * 100", "s")}, 2) AS segment_pct, first_ms, last_ms, word_rank FROM ranked"""

QUERIES["episode_stats"] = lambda spark, d: S.episode_stats(seg(spark, d))
ORACLE["episode_stats"] = f"""WITH {_EP} SELECT * FROM ep"""

QUERIES["corpus_summary"] = lambda spark, d: S.corpus_summary(seg(spark, d))
ORACLE["corpus_summary"] = f"""WITH {_EP},
a AS (SELECT "show", grouping("show") AS is_total, count(*) AS n_episodes, sum(n_segments) AS n_segments, sum(n_words) AS n_words, round(sum(total_ms) / 3600000.0, 2) AS hours,
  round(avg(total_ms) / 60000, 2) AS avg_minutes, round(avg(n_speakers), 2) AS avg_speakers FROM ep GROUP BY ROLLUP ("show")),
b AS (SELECT "show", grouping("show") AS is_total, count(DISTINCT speaker) AS n_speakers FROM seg GROUP BY ROLLUP ("show")),
c AS (SELECT "show", grouping("show") AS is_total, n_speakers, count(*) AS n FROM ep GROUP BY GROUPING SETS (("show", n_speakers), (n_speakers))),
m AS (SELECT "show", is_total, n_speakers AS mode_speakers, row_number() OVER (PARTITION BY "show", is_total ORDER BY n DESC, n_speakers) AS r FROM c)
SELECT a.*, b.n_speakers, m.mode_speakers FROM a JOIN b ON a."show" IS NOT DISTINCT FROM b."show" AND a.is_total = b.is_total
JOIN m ON a."show" IS NOT DISTINCT FROM m."show" AND a.is_total = m.is_total AND r = 1"""

QUERIES["podcast_totals"] = lambda spark, d: S.podcast_totals(seg(spark, d))
ORACLE["podcast_totals"] = f"""WITH {_EP}
SELECT "show", grouping("show") AS is_total, count(*) AS n_episodes, sum(n_segments) AS n_segments, sum(n_words) AS n_words, sum(total_ms) AS total_ms,
  round(sum(n_segments) / count(*), 2) AS avg_segments, round(sum(n_words) / count(*), 2) AS avg_words FROM ep GROUP BY ROLLUP ("show")"""

QUERIES["show_speakers"] = lambda spark, d: S.speakers_of_show(seg(spark, d))
ORACLE["show_speakers"] = f"""WITH {SEG},
n AS (SELECT "show", count(DISTINCT episode_id) AS total FROM seg GROUP BY 1),
g AS (SELECT "show", speaker, count(DISTINCT episode_id) AS n_episodes FROM seg GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY n_episodes DESC, speaker) AS rank FROM g)
SELECT r."show", speaker, n_episodes, rank, round(n_episodes * 100 / total, 2) AS episode_pct FROM r JOIN n USING ("show") WHERE rank <= 15"""

QUERIES["speaker_interactions"] = lambda spark, d: S.speaker_interactions(seg(spark, d))
ORACLE["speaker_interactions"] = f"""WITH {SEG},
g AS (SELECT "show", episode_id, speaker, sum({words("text")}) AS n_words, count(*) AS n_turns FROM seg GROUP BY ALL)
SELECT *, round({div("n_words * 100", "sum(n_words) OVER (PARTITION BY episode_id)")}, 2) AS word_pct, round({div("n_words", "n_turns")}, 2) AS words_per_turn FROM g"""

QUERIES["speaker_transitions"] = lambda spark, d: S.transitions(seg(spark, d))
ORACLE["speaker_transitions"] = f"""WITH {SEG},
p AS (SELECT "show", episode_id, lag(speaker) OVER (PARTITION BY episode_id ORDER BY segment_id) AS from_speaker, speaker AS to_speaker FROM seg),
g AS (SELECT *, count(*) AS n FROM p WHERE from_speaker IS NOT NULL AND from_speaker <> to_speaker GROUP BY ALL)
SELECT *, round(n * 100 / sum(n) OVER (PARTITION BY "show", episode_id, from_speaker), 2) AS pct FROM g"""

_RANK = f"""{SEG},
g AS (SELECT "show", episode_id, speaker, sum(greatest(end_ms - start_ms, 0)) AS time_ms, min(segment_id) AS first_segment, count(*) AS n_segments FROM seg GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY "show", episode_id ORDER BY time_ms DESC, first_segment, speaker) - 1 AS rank FROM g)"""
QUERIES["speaking_time_rank"] = lambda spark, d: S.speaking_ranks(seg(spark, d))
ORACLE["speaking_time_rank"] = f"""WITH {_RANK} SELECT * FROM rk"""

QUERIES["host_candidate"] = lambda spark, d: S.host_candidates(seg(spark, d))
ORACLE["host_candidate"] = f"""WITH {_RANK},
n AS (SELECT "show", count(DISTINCT episode_id) AS n_episodes FROM rk GROUP BY 1),
h AS (SELECT "show", rank, count(*) AS k, avg(time_ms / 1000.0) AS mean_s, stddev_samp(time_ms / 1000.0) AS sd_s FROM rk WHERE rank <= 3 GROUP BY ALL),
s AS (SELECT *, k / n_episodes AS presence, CASE WHEN k >= 2 THEN greatest(0, 1 - {div("sd_s", "mean_s")}) ELSE 0 END AS cons FROM h JOIN n USING ("show") WHERE mean_s > 0),
t AS (SELECT *, round(presence * CASE WHEN presence < 0.7 THEN 0.5 ELSE 1 END * (0.5 + 0.5 * cons), 6) AS score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY score DESC, rank) AS r FROM t)
SELECT "show", rank, k, n_episodes, round(mean_s, 3) AS mean_seconds, score FROM b WHERE r = 1 AND k >= least(3, n_episodes) AND rank <= 2"""

QUERIES["next_different_speaker"] = lambda spark, d: S.next_different_speaker(seg(spark, d))
ORACLE["next_different_speaker"] = f"""WITH {SEG},
w AS (SELECT *, list(speaker) OVER (PARTITION BY episode_id ORDER BY segment_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS nxt FROM seg)
SELECT "show", episode_id, segment_id, speaker, list_filter(nxt, lambda x: x <> speaker)[1] AS next_speaker FROM w"""

QUERIES["first_appearance"] = lambda spark, d: S.first_appearance(seg(spark, d))
ORACLE["first_appearance"] = f"""WITH {SEG},
g AS (SELECT "show", episode_id, speaker, min(segment_id) AS first_segment FROM seg GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY "show", episode_id ORDER BY first_segment, speaker) AS ord FROM g"""
