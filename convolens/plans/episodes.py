"""Queries on coverage, incremental work, timelines, feeds and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.functions.numbers import parse_duration, human_size, clock
from convolens.operators import coverage as C, feeds as D, keywords as K, labels as L, timeline as T
from convolens.operators.speakers import podcast_totals
from convolens.plans.base import CLS, SEG, TURNS, cls, div, seg, turns
from convolens.plans.keywords import _MATCH
from convolens.plans.labels import MODELS, _DOC, _docs
from convolens.plans.search import _ANN, ann
from convolens.plans.speakers import _EP
from convolens.session import table

QUERIES, ORACLE = {}, {}
_ep = lambda spark, d: D.current_episodes(table(spark, d, "episodes"))
EPI = """epi AS (SELECT episode_id, "show", title, audio_url, published, duration, description, episode_number, season_number, file_size, mime_type, fetched_at FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY fetched_at DESC NULLS LAST, "show" DESC NULLS LAST, title DESC NULLS LAST, audio_url DESC NULLS LAST, published DESC NULLS LAST, duration DESC NULLS LAST,
    description DESC NULLS LAST, episode_number DESC NULLS LAST, season_number DESC NULLS LAST, file_size DESC NULLS LAST, mime_type DESC NULLS LAST) AS r FROM episodes) WHERE r = 1)"""

# coverage
_kw = lambda spark, d: K.keyword_matches(seg(spark, d), table(spark, d, "lexicon"))
_out = lambda spark, d: C.episode_outputs(_ep(spark, d), segments=seg(spark, d), turns=turns(spark, d), matches=_kw(spark, d), documents=_docs(spark, d))
_OUT = f"""{EPI}, {_MATCH}, {TURNS}, out AS (SELECT "show", episode_id, coalesce(a.n, 0) AS n_segments, coalesce(b.n, 0) AS n_turns, coalesce(k.n, 0) AS n_matches, coalesce(e.n, 0) AS n_documents FROM epi
  LEFT JOIN (SELECT episode_id, count(*) AS n FROM seg GROUP BY 1) a USING (episode_id) LEFT JOIN (SELECT episode_id, count(*) AS n FROM tur GROUP BY 1) b USING (episode_id)
  LEFT JOIN (SELECT episode_id, count(*) AS n FROM m GROUP BY 1) k USING (episode_id) LEFT JOIN (SELECT episode_id, count(*) AS n FROM documents GROUP BY 1) e USING (episode_id)),
cov AS (SELECT "show", stage, count(*) AS total, sum(done) AS complete FROM (""" + " UNION ALL ".join(f"""SELECT "show", '{s}' AS stage, CAST(n_{s} > 0 AS INT) AS done FROM out""" for s in ("segments", "turns", "matches", "documents")) + f""") GROUP BY ALL),
cover AS (SELECT *, greatest(total - complete, 0) AS missing, round({div("complete * 100", "total")}, 2) AS pct FROM cov)"""
QUERIES["episode_outputs"] = _out
ORACLE["episode_outputs"] = f"WITH {_OUT} SELECT * FROM out"
QUERIES["coverage_dashboard"] = lambda spark, d: C.coverage(_out(spark, d))
ORACLE["coverage_dashboard"] = f"WITH {_OUT} SELECT * FROM cover"
QUERIES["show_health"] = lambda spark, d: C.health(C.coverage(_out(spark, d)))
ORACLE["show_health"] = f"""WITH {_OUT} SELECT "show", round(avg(round(pct * 100)), 0) / 100 AS health FROM cover GROUP BY 1"""
QUERIES["missing_outputs"] = lambda spark, d: C.missing_outputs(C.coverage(_out(spark, d)))
ORACLE["missing_outputs"] = f"""WITH {_OUT} SELECT "show", stage, missing FROM cover WHERE missing > 0"""

# incremental work
QUERIES["incremental_combine"] = lambda spark, d: C.pending(seg(spark, d).select("show", "episode_id").distinct(), C.combined_episodes(seg(spark, d)), ["show", "episode_id"])
ORACLE["incremental_combine"] = f"""WITH {SEG} SELECT "show", episode_id FROM seg GROUP BY ALL HAVING NOT bool_and(speaker <> 'UNKNOWN')"""
QUERIES["incremental_postprocess"] = lambda spark, d: C.postprocessed_episodes(seg(spark, d))
ORACLE["incremental_postprocess"] = f"""WITH {SEG} SELECT "show", episode_id FROM seg GROUP BY ALL HAVING bool_and(speaker <> 'UNKNOWN' AND regexp_matches(text, '[^\\x09-\\x0D\\x1C-\\x20\\x85\\pZ]'))"""
QUERIES["incremental_embed"] = lambda spark, d: C.embedded(table(spark, d, "embeddings"), "label")
ORACLE["incremental_embed"] = "SELECT label FROM embeddings GROUP BY 1 HAVING bool_and(coalesce(len(embedding), 0) > 0)"
QUERIES["incremental_classify"] = lambda spark, d: C.classified(cls(spark, d), _docs(spark, d), MODELS[1:3])
ORACLE["incremental_classify"] = f"""WITH {CLS}, h AS (SELECT doc_id, count(DISTINCT model_name) AS k FROM cls WHERE model_name IN ('{MODELS[1]}', '{MODELS[2]}') GROUP BY 1)
SELECT episode_id FROM documents LEFT JOIN h USING (doc_id) WHERE episode_id IS NOT NULL AND regexp_matches(coalesce(text, ''), '[^\\x09-\\x0D\\x1C-\\x20\\x85\\pZ]') GROUP BY 1 HAVING bool_and(coalesce(k, 0) = 2)"""
QUERIES["incremental_annotate"] = lambda spark, d: C.annotated(ann(spark, d))
ORACLE["incremental_annotate"] = f"WITH {_ANN} SELECT source FROM ann GROUP BY 1 HAVING bool_and(has_hate_speech IS NOT NULL)"


def _stored(spark, d):
    t = podcast_totals(seg(spark, d)).where("is_total = 0").select("show", "n_episodes", "n_words")
    return C.with_stored(t.where("n_episodes % 2 = 0"), t.withColumn("n_words", F.lit(-1).cast("bigint")), ["show"])


QUERIES["incremental_summary"] = _stored
ORACLE["incremental_summary"] = f"""WITH {_EP}, t AS (SELECT "show", count(*) AS n_episodes, sum(n_words) AS n_words FROM ep GROUP BY 1) SELECT "show", n_episodes, CASE WHEN n_episodes % 2 = 0 THEN n_words ELSE -1 END AS n_words FROM t"""

# timelines
_hate = lambda spark, d: _docs(spark, d).join(ann(spark, d).where("has_hate_speech").select("doc_id"), "doc_id")
QUERIES["hate_by_episode"] = lambda spark, d: T.counts_by_episode(_ep(spark, d), _hate(spark, d))
_HBE = f"""{EPI}, {_ANN}, hc AS (SELECT episode_id, count(*) AS n FROM ann WHERE has_hate_speech GROUP BY 1), hbe AS (SELECT "show", episode_id, coalesce(n, 0) AS n FROM epi LEFT JOIN hc USING (episode_id))"""
ORACLE["hate_by_episode"] = f"WITH {_HBE} SELECT * FROM hbe"
QUERIES["episode_trend"] = lambda spark, d: T.trend(T.counts_by_episode(_ep(spark, d), seg(spark, d)), "show", "episode_id", "n")
ORACLE["episode_trend"] = f"""WITH {EPI}, {SEG}, c AS (SELECT "show", episode_id, coalesce(n, 0) AS n FROM epi LEFT JOIN (SELECT episode_id, count(*) AS n FROM seg GROUP BY 1) USING (episode_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY episode_id) AS rn, count(*) OVER (PARTITION BY "show") AS k FROM c),
g AS (SELECT "show", coalesce(sum(n) FILTER (rn <= floor(k / 4)), 0) AS first, coalesce(sum(n) FILTER (rn > k - ceil(k / 4)), 0) AS last FROM r GROUP BY 1),
p AS (SELECT *, CASE WHEN first <> 0 THEN round((last - first) * 100 / first, 2) WHEN last <> 0 THEN 100.0 ELSE 0.0 END AS change_pct FROM g)
SELECT *, CASE WHEN change_pct > 20 THEN 'increasing' WHEN change_pct < -20 THEN 'decreasing' ELSE 'stable' END AS direction FROM p"""
QUERIES["episode_samples"] = lambda spark, d: T.sampled(T.counts_by_episode(_ep(spark, d), seg(spark, d)), "show", "episode_id", 5)
ORACLE["episode_samples"] = f"""WITH {EPI}, {SEG}, c AS (SELECT "show", episode_id, coalesce(n, 0) AS n FROM epi LEFT JOIN (SELECT episode_id, count(*) AS n FROM seg GROUP BY 1) USING (episode_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY episode_id) - 1 AS rn, count(*) OVER (PARTITION BY "show") AS k FROM c) SELECT "show", episode_id, n FROM r WHERE rn % greatest(k // 5, 1) = 0"""
QUERIES["duration_batches"] = lambda spark, d: T.duration_batches(_ep(spark, d).select("show", "episode_id", "duration"), "episode_id", "duration", 4)
ORACLE["duration_batches"] = f"""WITH {EPI} SELECT "show", episode_id, duration, CAST((row_number() OVER (PARTITION BY "show" ORDER BY duration NULLS FIRST, episode_id) - 1) // 4 AS INT) AS batch FROM epi"""
QUERIES["peak_concurrency"] = lambda spark, d: T.peak_concurrency(turns(spark, d), "episode_id", "start_ms", "end_ms")
ORACLE["peak_concurrency"] = f"""WITH {TURNS}, e AS (SELECT episode_id, start_ms AS t, 1 AS d FROM tur UNION ALL SELECT episode_id, end_ms, -1 FROM tur), m AS (SELECT episode_id, t, sum(d) AS d FROM e GROUP BY ALL),
r AS (SELECT episode_id, sum(d) OVER (PARTITION BY episode_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM m) SELECT episode_id, greatest(max(o), 0) AS peak FROM r GROUP BY 1"""
_log = lambda spark, d: _ep(spark, d).select(F.col("show").alias("session"), (F.col("duration") > 0).alias("ok"), F.col("file_size").alias("bytes"), F.col("duration").alias("seconds"))
QUERIES["session_metrics"] = lambda spark, d: T.session_metrics(_log(spark, d))
ORACLE["session_metrics"] = f"""WITH {EPI}, g AS (SELECT "show" AS session, count(*) AS n, count(*) FILTER (duration > 0) AS n_ok, sum(file_size) AS bytes, sum(duration) AS seconds FROM epi GROUP BY 1)
SELECT session, n, n_ok, round({div("n_ok * 100", "n")}, 2) AS success_pct, bytes, round({div("bytes", "seconds")}, 2) AS bytes_per_second, round({div("n * 60", "seconds")}, 4) AS items_per_minute FROM g"""
QUERIES["rate_eta"] = lambda spark, d: T.session_metrics(_log(spark, d)).select("session", F.round(T.eta_seconds(F.col("n_ok"), F.col("n"), F.lit(600.0)), 4).alias("eta"))
ORACLE["rate_eta"] = f"""WITH {EPI}, g AS (SELECT "show" AS session, count(*) AS n, count(*) FILTER (duration > 0) AS n_ok FROM epi GROUP BY 1) SELECT session, round({div("(n - n_ok) * 600", "n_ok")}, 4) AS eta FROM g"""
QUERIES["rolling_average"] = lambda spark, d: T.rolling_average(table(spark, d, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("value")), "user_id", ["ts", "event_id"], "value").select("event_id", "rolling")
ORACLE["rolling_average"] = "SELECT event_id, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rolling FROM events"

# feeds
QUERIES["current_episodes"] = _ep
ORACLE["current_episodes"] = f"WITH {EPI} SELECT * FROM epi"
QUERIES["episode_filter"] = lambda spark, d: D.filter_episodes(_ep(spark, d), "2020-01-01", "2024-12-31", newest=30).select("episode_id", "published")
ORACLE["episode_filter"] = f"WITH {EPI} SELECT episode_id, published FROM epi WHERE published >= TIMESTAMP '2020-01-01' AND published <= TIMESTAMP '2024-12-31' ORDER BY published DESC, episode_id LIMIT 30"
QUERIES["episode_keys"] = lambda spark, d: _ep(spark, d).select("episode_id", D.episode_key(F.when(F.length("title") % 2 == 0, F.col("episode_id")), F.col("audio_url"), F.col("title"), F.col("description")).alias("key"), D.is_audio(F.col("audio_url"), F.col("mime_type")).alias("audio"))
ORACLE["episode_keys"] = f"""WITH {EPI} SELECT episode_id, CASE WHEN length(title) % 2 = 0 THEN episode_id ELSE left(sha256(concat_ws(':', audio_url, title, description)), 16) END AS key,
  coalesce(starts_with(mime_type, 'audio/'), false) OR coalesce(regexp_matches(lower(audio_url), '\\.(mp3|m4a|ogg|wav)([?#]|$)'), false) AS audio FROM epi"""
QUERIES["durations"] = lambda spark, d: _ep(spark, d).select("episode_id", clock(F.col("duration")).alias("clock"), parse_duration(F.concat(F.floor(F.col("duration") / 60).cast("string"), F.lit(":"), (F.col("duration") % 60).cast("string"))).alias("seconds"), human_size(F.col("file_size")).alias("size"))
ORACLE["durations"] = f"""WITH {EPI} SELECT episode_id, printf('%02d:%02d', duration // 60, duration % 60) AS clock, duration AS seconds, CASE WHEN file_size < 1024 THEN printf('%.1f B', CAST(file_size AS DOUBLE)) WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024.0)
  WHEN file_size < 1073741824 THEN printf('%.1f MB', file_size / 1048576.0) ELSE printf('%.1f GB', file_size / 1073741824.0) END AS size FROM epi"""
QUERIES["long_enough"] = lambda spark, d: D.long_enough(_ep(spark, d), 1800).select("episode_id", "duration")
ORACLE["long_enough"] = f"WITH {EPI} SELECT episode_id, duration FROM epi WHERE duration IS NULL OR duration >= 1800"
QUERIES["too_small"] = lambda spark, d: D.too_small(_ep(spark, d), 20000).select("episode_id", "file_size")
ORACLE["too_small"] = f"WITH {EPI} SELECT episode_id, file_size FROM epi WHERE file_size < 20000 * 1024"
QUERIES["distinct_feeds"] = lambda spark, d: D.distinct_feeds(table(spark, d, "shows").unionByName(table(spark, d, "shows")), "show").select("show", "feed_url")
ORACLE["distinct_feeds"] = 'SELECT "show", feed_url FROM (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY "show") AS r FROM shows) WHERE r = 1'
QUERIES["popular_shows"] = lambda spark, d: D.popular(podcast_totals(seg(spark, d)).where("is_total = 0"), "n_episodes", 10).select("show", "n_episodes")
ORACLE["popular_shows"] = f"""WITH {SEG} SELECT "show", count(DISTINCT episode_id) AS n_episodes FROM seg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
QUERIES["find_podcast"] = lambda spark, d: D.find_podcast(table(spark, d, "shows"), "The").select("show", "title")
ORACLE["find_podcast"] = """SELECT "show", title FROM shows WHERE contains(lower(title), 'the') OR contains('the', lower(title))"""
QUERIES["store_statistics"] = lambda spark, d: D.store_statistics(_ep(spark, d))
ORACLE["store_statistics"] = f"""WITH {EPI} SELECT count(DISTINCT "show") AS n_podcasts, count(*) AS n_episodes, coalesce(sum(file_size), 0) AS bytes FROM epi"""
QUERIES["not_stored"] = lambda spark, d: D.not_stored(_ep(spark, d), seg(spark, d)).select("episode_id")
ORACLE["not_stored"] = f"WITH {EPI}, {SEG} SELECT episode_id FROM epi WHERE episode_id NOT IN (SELECT episode_id FROM seg)"
QUERIES["folder_sizes"] = lambda spark, d: D.folder_sizes(_ep(spark, d))
ORACLE["folder_sizes"] = f"""WITH {EPI} SELECT "show", count(*) AS n_files, coalesce(sum(file_size), 0) AS bytes, round({div("sum(file_size)", "count(file_size)")}, 2) AS mean_bytes FROM epi GROUP BY 1"""
_feeds = lambda spark, d: table(spark, d, "shows").select(F.lit("q").alias("query"), "show", "title", (F.length("title") / 100).alias("confidence"), (F.length("show") / 50).alias("fuzzy"), (F.length("feed_url") * 5).alias("n_episodes"))
QUERIES["feed_ranking"] = lambda spark, d: D.rank_feeds(_feeds(spark, d)).select("show", "blend", "score", "rank")
ORACLE["feed_ranking"] = """WITH f AS (SELECT "show", title, length(title) / 100 AS c, length("show") / 50 AS z, length(feed_url) * 5 AS n FROM shows), s AS (SELECT "show", title, round(0.5 * c + 0.5 * z, 6) AS blend, round(0.4 * c + 0.4 * z + least(n / 1000, 0.2), 6) AS score FROM f)
SELECT "show", blend, score, row_number() OVER (ORDER BY score DESC, title) AS rank FROM s"""


# the widest summary: one row a show of everything
def show_summary(spark, d):
    t = podcast_totals(seg(spark, d)).where("is_total = 0").drop("is_total")
    kw = _kw(spark, d).groupBy("show").agg(F.count("*").alias("n_matches"), F.countDistinct("episode_id").alias("n_matched_episodes"))
    v = L.show_votes(cls(spark, d), _docs(spark, d)).where("is_total = 0").select(F.col("source").alias("show"), "n_positive", "n_negative", "label")
    h = ann(spark, d).groupBy(F.col("source").alias("show")).agg(F.count_if("has_hate_speech").alias("n_hate"), F.count_if("has_advertisement").alias("n_ads"))
    return t.join(kw, "show", "left").join(v, "show", "left").join(h, "show", "left").fillna(0, ["n_matches", "n_matched_episodes", "n_positive", "n_negative", "n_hate", "n_ads"])


QUERIES["show_summary"] = show_summary
ORACLE["show_summary"] = f"""WITH {_EP}, {_MATCH[len(SEG) + 2:]}, {_DOC}, {_ANN[len(CLS) + 2:]},
t AS (SELECT "show", count(*) AS n_episodes, sum(n_segments) AS n_segments, sum(n_words) AS n_words, sum(total_ms) AS total_ms, round(sum(n_segments) / count(*), 2) AS avg_segments, round(sum(n_words) / count(*), 2) AS avg_words FROM ep GROUP BY 1),
kw AS (SELECT "show", count(*) AS n_matches, count(DISTINCT episode_id) AS n_matched_episodes FROM m GROUP BY 1),
v AS (SELECT source AS "show", count(*) FILTER (label = 'POSITIVE') AS n_positive, count(*) FILTER (label = 'NEGATIVE') AS n_negative FROM dl JOIN documents USING (doc_id) GROUP BY 1),
ha AS (SELECT source AS "show", count(*) FILTER (has_hate_speech) AS n_hate, count(*) FILTER (has_advertisement) AS n_ads FROM ann GROUP BY 1)
SELECT t.*, coalesce(n_matches, 0) AS n_matches, coalesce(n_matched_episodes, 0) AS n_matched_episodes, coalesce(n_positive, 0) AS n_positive, coalesce(n_negative, 0) AS n_negative,
  CASE WHEN v."show" IS NULL THEN NULL WHEN n_positive + n_negative = 0 THEN 'UNKNOWN' WHEN n_positive >= n_negative THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, coalesce(n_hate, 0) AS n_hate, coalesce(n_ads, 0) AS n_ads
FROM t LEFT JOIN kw USING ("show") LEFT JOIN v USING ("show") LEFT JOIN ha USING ("show")"""
