"""Queries on derived properties, names in file names and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.operators import derived as D, features as X, keywords as K, names as N, speakers as S
from convolens.plans.base import SEG, div, seg
from convolens.plans.episodes import EPI, _ep
from convolens.plans.keywords import _MATCH
from convolens.plans.matching import _MAPPED, _SANITY, _SCORE, _mapped, _side, names_sql
from convolens.plans.speakers import _EP
from convolens.session import table

QUERIES, ORACLE = {}, {}

QUERIES["balance_scores"] = lambda spark, d: D.balance_scores(X.turn_taking_by_speaker(seg(spark, d)).where("time_ms > 0"), ["show", "episode_id"], "time_ms")
ORACLE["balance_scores"] = f"""WITH {SEG}, t AS (SELECT "show", episode_id, speaker, sum(end_ms - start_ms) AS v FROM seg GROUP BY ALL HAVING sum(end_ms - start_ms) > 0), s AS (SELECT "show", episode_id, v / sum(v) OVER (PARTITION BY "show", episode_id) AS s FROM t)
SELECT "show", episode_id, CASE WHEN count(*) = 1 THEN 1.0 ELSE round(greatest(0, 1 - 2 * stddev_pop(s)), 4) END AS balance FROM s GROUP BY ALL"""
QUERIES["intro_words"] = lambda spark, d: X.episode_text(seg(spark, d)).select("episode_id", D.first_words(F.col("text")).alias("intro"))
ORACLE["intro_words"] = f"""WITH {SEG}, t AS (SELECT episode_id, string_agg(text, ' ' ORDER BY segment_id) AS text FROM seg GROUP BY 1)
SELECT episode_id, array_to_string(regexp_extract_all(text, '[^\\x09-\\x0D\\x1C-\\x20\\x85\\pZ]+')[1:500], ' ') AS intro FROM t"""
_titles = lambda spark, d: (table(spark, d, "shows").select(F.col("title").alias("query")), _ep(spark, d).select(F.col("title").alias("target")).where("target is not null"))
QUERIES["best_match"] = lambda spark, d: D.best_match(*_titles(spark, d))
QUERIES["rank_results"] = lambda spark, d: D.rank_results(*_titles(spark, d), top=3)
_TT = f"""{EPI}, q AS (SELECT title AS query, {_side("title")} AS q FROM (SELECT DISTINCT title FROM shows)), t AS (SELECT title AS target, {_side("title")} AS t FROM (SELECT DISTINCT title FROM epi WHERE title IS NOT NULL)), sc AS (SELECT query, target, {_SCORE} AS score FROM q, t)"""
ORACLE["best_match"] = f"WITH {_TT}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, reverse(target) DESC) AS r FROM sc WHERE score > 0.3) SELECT query, target, score FROM r WHERE r = 1"
ORACLE["rank_results"] = f"WITH {_TT}, r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank, target, score FROM sc) SELECT * FROM r WHERE rank <= 3"
ORACLE["episode_metadata"] = f"""WITH {EPI}, j AS (SELECT episode_id, CASE WHEN episode_number % 2 = 0 THEN nullif(trim(author), '') END AS feed, CASE WHEN episode_number % 3 = 0 THEN nullif(trim(author), '') END AS known, {names_sql(_SANITY("e.title"))} AS names FROM epi e JOIN shows s USING ("show")),
h AS (SELECT *, coalesce(feed, known, names[1]) AS host FROM j)
SELECT episode_id, host, array_to_string(list_filter(names, lambda n: coalesce(lower(n) <> lower(host), true)), ';') AS guests, CASE WHEN feed IS NOT NULL THEN 'feed' WHEN known IS NOT NULL THEN 'known_host' WHEN len(names) > 0 THEN 'filename' ELSE 'none' END AS source,
  CASE WHEN feed IS NOT NULL THEN 0.9e0 WHEN known IS NOT NULL THEN 0.8e0 WHEN len(names) > 0 THEN 0.5e0 ELSE 0.3e0 END AS confidence FROM h"""
QUERIES["episode_metadata"] = lambda spark, d: D.episode_metadata(_ep(spark, d).join(table(spark, d, "shows").select("show", "author"), "show").select("episode_id", F.when(F.col("episode_number") % 2 == 0, F.col("author")).alias("feed_author"), F.when(F.col("episode_number") % 3 == 0, F.col("author")).alias("known_host"), N.names_in_filename(T.sanitize_name(F.col("title"))).alias("file_names"))).select("episode_id", "host", F.array_join("guests", ";").alias("guests"), "source", "confidence")
QUERIES["hosts_of_shows"] = lambda spark, d: D.hosts_of_shows(_mapped(spark, d), _ep(spark, d))
ORACLE["hosts_of_shows"] = f"""{_MAPPED} SELECT "show", name, role, count(DISTINCT episode_id) AS n_episodes FROM mp JOIN (SELECT episode_id, "show" FROM epi) e USING (episode_id) WHERE role IN ('HOST', 'GUEST') GROUP BY ALL"""
ORACLE["labeling_confidence"] = f"""{_MAPPED} SELECT CAST(r.b AS INT) AS bucket, count(mp.name) AS n FROM (SELECT unnest(range(10)) AS b) r LEFT JOIN mp ON least(floor(mp.confidence * 10), 9) = r.b GROUP BY 1"""
QUERIES["labeling_confidence"] = lambda spark, d: D.confidence_buckets(_mapped(spark, d))
QUERIES["compare_episodes"] = lambda spark, d: D.compare_episodes(S.episode_stats(seg(spark, d)), "n_words")
ORACLE["compare_episodes"] = f"WITH {_EP}, f AS (SELECT episode_id, CAST(n_words AS DOUBLE) AS value FROM ep ORDER BY episode_id LIMIT 10) SELECT *, round(avg(value) OVER (), 4) AS average FROM f"
QUERIES["throughput"] = lambda spark, d: D.throughput(_ep(spark, d).select(F.col("show").alias("session"), F.coalesce("episode_number", F.lit(0)).alias("items"), F.lit(1).alias("files"), F.lit(2).alias("batches"), (F.coalesce("duration", F.lit(0)) * 10).alias("ms")))
ORACLE["throughput"] = f"""WITH {EPI}, g AS (SELECT "show" AS session, sum(coalesce(episode_number, 0)) AS i, count(*) AS f, count(*) * 2 AS b, sum(coalesce(duration, 0) * 10) AS ms FROM epi GROUP BY 1)
SELECT session, round({div("i * 1000", "ms")}, 4) AS items_per_second, round({div("f * 60000", "ms")}, 4) AS files_per_minute, round({div("ms", "b")}, 4) AS avg_batch_ms FROM g"""
QUERIES["time_stamps"] = lambda spark, d: _ep(spark, d).select("episode_id", D.stamp(F.col("published")).alias("stamp"), F.date_format("published", "yyyy-MM-dd").alias("day"))
ORACLE["time_stamps"] = f"WITH {EPI} SELECT episode_id, strftime(published, '%Y_%m_%d_%H_%M_%S') AS stamp, strftime(published, '%Y-%m-%d') AS day FROM epi"
QUERIES["match_rate"] = lambda spark, d: D.match_rate(K.keyword_matches(seg(spark, d), table(spark, d, "lexicon")), seg(spark, d))
ORACLE["match_rate"] = f"WITH {_MATCH} SELECT (SELECT count(DISTINCT episode_id) FROM seg) AS n_episodes, count(DISTINCT episode_id) AS n_matched, round(count(DISTINCT episode_id) * 100 / (SELECT count(DISTINCT episode_id) FROM seg), 2) AS match_rate FROM m"
QUERIES["keyword_highlights"] = lambda spark, d: seg(spark, d).where("contains(lower(text), 'bread')").select("episode_id", "segment_id", T.highlight(F.col("text"), "bread").alias("text"), T.truncated(F.col("text"), 60).alias("short"))
ORACLE["keyword_highlights"] = f"""WITH {SEG} SELECT episode_id, segment_id, regexp_replace(text, '(bread)', '[\\1]', 'gi') AS text, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short FROM seg WHERE contains(lower(text), 'bread')"""
QUERIES["document_sentiment_of_matches"] = lambda spark, d: _joined(spark, d)


def _joined(spark, d):
    """Keyword matches of episodes beside the sentiment of their documents."""
    from convolens.operators.labels import document_sentiment
    from convolens.plans.base import cls

    m = K.keyword_matches(seg(spark, d), table(spark, d, "lexicon")).groupBy("episode_id").agg(F.count("*").alias("n_matches"))
    s = document_sentiment(cls(spark, d)).join(table(spark, d, "documents").select("doc_id", "episode_id"), "doc_id").groupBy("episode_id").agg(F.count_if(F.col("sentiment") == "negative").alias("n_negative"))
    return m.join(s, "episode_id", "left").fillna(0, ["n_negative"])


from convolens.plans.labels import _SENT  # noqa: E402

ORACLE["document_sentiment_of_matches"] = f"""WITH {_MATCH}, {_SENT.replace("f AS (", "sf AS (", 1).replace("FROM f GROUP", "FROM sf GROUP")}, g AS (SELECT episode_id, count(*) FILTER (sentiment = 'negative') AS n_negative FROM ds JOIN documents USING (doc_id) GROUP BY 1)
SELECT episode_id, n_matches, coalesce(n_negative, 0) AS n_negative FROM (SELECT episode_id, count(*) AS n_matches FROM m GROUP BY 1) LEFT JOIN g USING (episode_id)"""
