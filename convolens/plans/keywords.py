"""Queries on keywords."""

from __future__ import annotations

from convolens.operators import keywords as K
from convolens.plans.base import SEG, div, seg, words
from convolens.session import table

QUERIES, ORACLE = {}, {}


def _m(spark, d):
    return K.keyword_matches(seg(spark, d), table(spark, d, "lexicon"))


# a match's neighbours are no letters, digits or marks; places are tried one by one
_LEX = """lex AS (SELECT ord, keyword, category, tier FROM (SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY ord) AS r FROM lexicon WHERE keyword IS NOT NULL) WHERE r = 1 AND length(keyword) >= 2)"""
_MATCH = f"""{SEG}, {_LEX},
cand AS (SELECT seg.*, keyword, category, tier FROM seg JOIN lex ON contains(lower(text), lower(keyword))),
p AS (SELECT "show", episode_id, segment_id, speaker, start_ms, end_ms, text, keyword, category, tier, unnest(range(1, length(text) + 1)) AS i FROM cand),
h AS (SELECT * FROM p WHERE lower(substr(text, i, length(keyword))) = lower(keyword)
  AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[\\pL\\pN\\pM_]')) AND NOT regexp_matches(substr(text, i + length(keyword), 1), '[\\pL\\pN\\pM_]')),
m AS (SELECT "show", episode_id, segment_id, speaker, start_ms, end_ms, keyword, category, tier, substr(text, i, length(keyword)) AS matched_text, CAST(i - 1 AS INT) AS position,
  substr(text, greatest(i - 50, 1), least(i - 1, 50)) AS context_before, substr(text, i + length(keyword), 50) AS context_after FROM h)"""
QUERIES["keyword_matches"] = _m
ORACLE["keyword_matches"] = f"WITH {_MATCH} SELECT * FROM m"
QUERIES["keyword_stats"] = lambda spark, d: K.match_statistics(_m(spark, d))
ORACLE["keyword_stats"] = f"""WITH {_MATCH}
SELECT 'keyword' AS dimension, keyword AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'speaker', speaker, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'tier', t.tier, count(m.tier) FROM (VALUES ('high_confidence'), ('exploratory')) t(tier) LEFT JOIN m USING (tier) GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM m"""
QUERIES["keyword_timeline"] = lambda spark, d: K.keyword_timeline(_m(spark, d))
ORACLE["keyword_timeline"] = f"""WITH {_MATCH},
b AS (SELECT episode_id, start_ms, min(start_ms) OVER e AS lo, max(start_ms) OVER e AS hi FROM m WINDOW e AS (PARTITION BY episode_id)),
g AS (SELECT episode_id, least(floor((start_ms - lo) * 10 / (hi - lo)), 9) AS bin, count(*) AS n FROM b WHERE hi > lo GROUP BY ALL)
SELECT e.episode_id, CAST(r.bin AS INT) AS bin, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT episode_id FROM g) e CROSS JOIN (SELECT unnest(range(10)) AS bin) r LEFT JOIN g ON g.episode_id = e.episode_id AND g.bin = r.bin"""
QUERIES["keyword_gate"] = lambda spark, d: K.gated_episodes(seg(spark, d).select("show", "episode_id").distinct(), _m(spark, d), 20)
ORACLE["keyword_gate"] = f"""WITH {_MATCH} SELECT DISTINCT "show", episode_id FROM seg WHERE episode_id IN (SELECT episode_id FROM m GROUP BY 1 HAVING count(*) >= 20)"""
QUERIES["category_stats"] = lambda spark, d: K.category_statistics(_m(spark, d))
ORACLE["category_stats"] = f"WITH {_MATCH} SELECT category, count(*) AS n_matches, count(DISTINCT episode_id) AS n_episodes, count(DISTINCT keyword) AS n_keywords FROM m GROUP BY 1"
QUERIES["category_heatmap"] = lambda spark, d: K.category_heatmap(_m(spark, d))
ORACLE["category_heatmap"] = f"""WITH {_MATCH}, g AS (SELECT "show", category, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT DISTINCT "show" FROM g ORDER BY 1 LIMIT 10), c AS (SELECT category FROM g GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 10),
x AS (SELECT s."show", c.category, coalesce(g.n, 0) AS n FROM s CROSS JOIN c LEFT JOIN g ON g."show" = s."show" AND g.category = c.category)
SELECT *, CAST(least(3, floor({div("n * 4", "max(n) OVER ()")})) AS INT) AS intensity FROM x"""
QUERIES["keyword_density"] = lambda spark, d: K.keyword_density(_m(spark, d), seg(spark, d))
ORACLE["keyword_density"] = f"""WITH {_MATCH}, n AS (SELECT episode_id, sum({words("text")}) AS n_words FROM seg GROUP BY 1), g AS (SELECT episode_id, count(*) AS n_matches, count(DISTINCT category) AS n_categories FROM m GROUP BY 1)
SELECT episode_id, n_words, coalesce(n_matches, 0) AS n_matches, coalesce(n_categories, 0) AS n_categories, round({div("n_matches * 1000", "n_words")}, 4) AS match_density FROM n LEFT JOIN g USING (episode_id)"""
QUERIES["top_keywords"] = lambda spark, d: K.top_keywords(_m(spark, d))
ORACLE["top_keywords"] = f"WITH {_MATCH} SELECT keyword, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, keyword LIMIT 10"
QUERIES["keyword_members"] = lambda spark, d: K.keyword_members(_m(spark, d), ["Um", "you know", "idiot"])
ORACLE["keyword_members"] = f"""WITH {_MATCH} SELECT "show", episode_id, count(*) AS n_matches, count(DISTINCT lower(keyword)) AS n_keywords FROM m WHERE lower(keyword) IN ('um', 'you know', 'idiot') GROUP BY ALL"""
QUERIES["lexicon_distinct"] = lambda spark, d: K.distinct_keywords(table(spark, d, "lexicon"))
ORACLE["lexicon_distinct"] = "SELECT ord, category, tier, keyword, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY ord) AS r FROM lexicon WHERE keyword IS NOT NULL) WHERE r = 1"
QUERIES["keyword_lookup"] = lambda spark, d: K.keyword_lookup(table(spark, d, "lexicon").selectExpr("trim(keyword) as word").distinct(), table(spark, d, "lexicon"))
ORACLE["keyword_lookup"] = """WITH f AS (SELECT lower(keyword) AS k, category, tier, row_number() OVER (PARTITION BY lower(keyword) ORDER BY tier <> 'high_confidence', ord) AS r FROM lexicon WHERE keyword IS NOT NULL)
SELECT w.word, f.category, f.tier FROM (SELECT DISTINCT trim(keyword) AS word FROM lexicon) w LEFT JOIN f ON lower(w.word) = f.k AND f.r = 1"""
