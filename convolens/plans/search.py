"""Queries on annotations, vectors and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.operators import annotations as A, embeddings as V, keywords as K, search as S
from convolens.plans.base import CLS, SEG, cls, div, seg
from convolens.plans.keywords import _MATCH
from convolens.session import table

QUERIES, ORACLE = {}, {}


def ann(spark, d):
    """Annotations as an annotator would give them, made of the classifiers' labels: a deterministic stand-in."""
    c = cls(spark, d)
    g = c.groupBy("doc_id").agg(F.max(F.when(F.col("model_name") == "hate_speech_detection", F.col("label"))).alias("hate"), F.max(F.when(F.col("model_name") == "fine_grained_hate_speech_detection", F.col("label"))).alias("fine"))
    j = g.join(table(spark, d, "documents").select("doc_id", "source", "episode_id", "kind"), "doc_id")
    hate = F.when(F.col("hate") == "HATE", True).when(F.col("hate") == "NOT-HATE", False)
    group = F.when(hate, F.element_at(F.array(*map(F.lit, ("Women", "racial", "ETHNIC", "aliens", "political", "none"))), (F.col("doc_id") % 6 + 1).cast("int")))
    return j.select("doc_id", "source", "episode_id", hate.alias("has_hate_speech"), (F.col("doc_id") % 7 == 0).alias("has_advertisement"), A.enumerated(group, A.TARGET_GROUPS).alias("target_group"), A.enumerated(F.when(hate, F.coalesce("fine", F.lit("slurs"))), A.SPEECH_TYPES).alias("hate_speech_type"), F.concat(F.lit(" "), F.upper("kind")).alias("main_topic"))


_ANN = f"""{CLS}, ag AS (SELECT doc_id, max(label) FILTER (model_name = 'hate_speech_detection') AS hate, max(label) FILTER (model_name = 'fine_grained_hate_speech_detection') AS fine FROM cls GROUP BY 1),
ah AS (SELECT doc_id, source, episode_id, kind, CASE hate WHEN 'HATE' THEN true WHEN 'NOT-HATE' THEN false END AS h, fine FROM ag JOIN documents USING (doc_id)),
ann AS (SELECT doc_id, source, episode_id, h AS has_hate_speech, doc_id % 7 = 0 AS has_advertisement, CASE WHEN h THEN ['women', 'racial', 'ethnic', 'other', 'political', 'other'][doc_id % 6 + 1] END AS target_group,
  CASE WHEN h THEN CASE WHEN fine IS NULL THEN 'slurs' ELSE 'other' END END AS hate_speech_type, ' ' || upper(kind) AS main_topic FROM ah)"""

QUERIES["annotations"] = ann
ORACLE["annotations"] = f"WITH {_ANN} SELECT * FROM ann"
QUERIES["annotation_summary"] = lambda spark, d: A.summary(ann(spark, d))
ORACLE["annotation_summary"] = f"""WITH {_ANN} SELECT count(*) AS n, count(*) FILTER (has_hate_speech) AS n_hate, count(*) FILTER (has_advertisement) AS n_ads, round({div("count(*) FILTER (has_hate_speech) * 100", "count(*)")}, 2) AS hate_pct, round({div("count(*) FILTER (has_advertisement) * 100", "count(*)")}, 2) AS ad_pct FROM ann"""
_DIST = "SELECT 'target_group' AS dimension, target_group AS value, count(*) AS n FROM {0} WHERE target_group IS NOT NULL GROUP BY ALL UNION ALL SELECT 'hate_speech_type', hate_speech_type, count(*) FROM {0} WHERE hate_speech_type IS NOT NULL GROUP BY ALL"
QUERIES["annotation_distributions"] = lambda spark, d: A.distributions(ann(spark, d))
ORACLE["annotation_distributions"] = f"WITH {_ANN} {_DIST.format('ann')} UNION ALL SELECT 'main_topic', main_topic, count(*) FROM ann WHERE main_topic IS NOT NULL GROUP BY ALL"
QUERIES["annotation_hate_distributions"] = lambda spark, d: A.hate_distributions(ann(spark, d))
ORACLE["annotation_hate_distributions"] = f"WITH {_ANN}, ha AS (SELECT * FROM ann WHERE has_hate_speech) {_DIST.format('ha')}"
QUERIES["annotation_topics"] = lambda spark, d: A.top_topics(ann(spark, d))
ORACLE["annotation_topics"] = f"WITH {_ANN} SELECT lower(trim(main_topic)) AS topic, count(*) AS n FROM ann WHERE trim(main_topic) <> '' GROUP BY 1 ORDER BY n DESC, topic LIMIT 20"
QUERIES["annotation_dataset"] = lambda spark, d: A.dataset(ann(spark, d))
ORACLE["annotation_dataset"] = f"WITH {_ANN} SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS segment_id FROM ann WHERE has_hate_speech IS NOT NULL"
QUERIES["annotation_filter"] = lambda spark, d: A.filtered(ann(spark, d), target_group="racial", has_hate=True, limit=20)
ORACLE["annotation_filter"] = f"WITH {_ANN} SELECT * FROM ann WHERE target_group = 'racial' AND has_hate_speech ORDER BY doc_id LIMIT 20"
QUERIES["hate_by_source"] = lambda spark, d: A.hate_by_source(ann(spark, d))
ORACLE["hate_by_source"] = f"""WITH {_ANN}, h AS (SELECT * FROM ann WHERE has_hate_speech), g AS (SELECT source, count(*) AS n_hate, count(DISTINCT episode_id) AS n_episodes FROM h GROUP BY 1),
n AS (SELECT source, target_group, count(*) AS n FROM h WHERE target_group IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target_group) AS r FROM n),
u AS (SELECT source, string_agg(target_group, ',' ORDER BY r) AS top_groups FROM t WHERE r <= 10 GROUP BY 1) SELECT g.*, top_groups FROM g LEFT JOIN u USING (source)"""

_EMB = """lv AS (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding IS NOT NULL) GROUP BY ALL),
tax AS (SELECT label, list(x ORDER BY i) AS vector FROM lv GROUP BY 1),
sim AS (SELECT vec_id, tax.label, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), vector), 6) AS similarity FROM embeddings, tax),
em AS (SELECT * FROM sim WHERE similarity >= 0.1)"""
_em = lambda spark, d: V.threshold_matches(table(spark, d, "embeddings"), V.centroids(table(spark, d, "embeddings"), "label"), 0.1)
QUERIES["cosine_threshold_matches"] = _em
ORACLE["cosine_threshold_matches"] = f"WITH {_EMB} SELECT * FROM em"
QUERIES["similarity_summary"] = lambda spark, d: V.similarity_summary(_em(spark, d))
ORACLE["similarity_summary"] = f"WITH {_EMB} SELECT label, grouping(label) AS is_total, count(*) AS n, round(avg(similarity), 3) AS avg_similarity FROM em GROUP BY ROLLUP (label)"
QUERIES["similarity_diagnostics"] = lambda spark, d: V.similarity_diagnostics(_em(spark, d))
ORACLE["similarity_diagnostics"] = f"WITH {_EMB}, b AS (SELECT vec_id, max(similarity) AS s FROM em GROUP BY 1) SELECT min(s) AS lowest, max(s) AS highest, round(avg(s), 6) AS mean FROM b"


def _taxonomy(spark, d):
    lex = table(spark, d, "lexicon")
    groups = lex.where("lang is not null").select(F.col("lang").alias("id")).distinct()
    strategies = lex.where("category is not null").select(F.col("category").alias("id"), F.concat(F.lit("about "), "category").alias("description")).distinct()
    examples = lex.select(F.col("lang").alias("target_group_id"), F.col("category").alias("strategy_id"), "ord", F.col("keyword").alias("item"))
    return V.taxonomy_texts(groups, strategies, examples)


QUERIES["taxonomy_texts"] = _taxonomy
ORACLE["taxonomy_texts"] = """WITH g AS (SELECT DISTINCT lang FROM lexicon WHERE lang IS NOT NULL), s AS (SELECT DISTINCT category FROM lexicon WHERE category IS NOT NULL),
e AS (SELECT lang, category, list(keyword ORDER BY ord) AS items FROM lexicon GROUP BY ALL)
SELECT g.lang AS target_group_id, s.category AS strategy_id, concat_ws(' ', 'about ' || s.category, array_to_string(items[1:10], ' ')) AS text, CAST(coalesce(len(items), 0) AS INT) AS example_count
FROM g CROSS JOIN s LEFT JOIN e ON e.lang = g.lang AND e.category = s.category"""

_S = "h AS (SELECT \"show\", episode_id, segment_id, speaker, text, CAST(instr(lower(text), '{0}') AS INT) AS a FROM seg WHERE contains(lower(text), '{0}')), hs AS (SELECT \"show\", episode_id, segment_id, speaker, greatest(a - 50, 1) AS b, least(a + {1} + 50, length(text) + 1) AS e, text FROM h), st AS (SELECT \"show\", episode_id, segment_id, speaker, CASE WHEN b > 1 THEN '...' ELSE '' END || substr(text, b, e - b) || CASE WHEN e <= length(text) THEN '...' ELSE '' END AS context FROM hs ORDER BY 1, 2, 3 LIMIT 50)"
QUERIES["search_transcripts"] = lambda spark, d: S.search_texts(seg(spark, d), "railway")
ORACLE["search_transcripts"] = f"WITH {SEG}, {_S.format('railway', 7)} SELECT * FROM st"
_mm = lambda spark, d: K.keyword_matches(seg(spark, d), table(spark, d, "lexicon"))
QUERIES["search_keywords"] = lambda spark, d: S.search_matches(_mm(spark, d), "^u", "FILLER")
ORACLE["search_keywords"] = f"""WITH {_MATCH} SELECT "show", episode_id, segment_id, keyword, category, position FROM m WHERE lower(category) = 'filler' AND starts_with(lower(keyword), 'u') ORDER BY "show", episode_id, segment_id, keyword, position LIMIT 50"""
QUERIES["search_annotations"] = lambda spark, d: S.search_annotations(ann(spark, d), "prose|racial", has_hate=True)
_SA = "SELECT source, episode_id, doc_id, main_topic, target_group FROM ann WHERE (regexp_matches(main_topic, '(?i)prose|racial') OR coalesce(regexp_matches(target_group, '(?i)prose|racial'), false)) {0} ORDER BY doc_id LIMIT 50"
ORACLE["search_annotations"] = f"WITH {_ANN} " + _SA.format("AND has_hate_speech")
QUERIES["global_search"] = lambda spark, d: S.global_search(seg(spark, d), _mm(spark, d), ann(spark, d), "um")
ORACLE["global_search"] = f"""WITH {_MATCH}, {_ANN}, a AS (SELECT "show" FROM seg WHERE contains(lower(text), 'um') ORDER BY "show", episode_id, segment_id LIMIT 50),
b AS (SELECT "show" FROM m WHERE contains(lower(keyword), 'um') ORDER BY "show", episode_id, segment_id, keyword, position LIMIT 50),
c AS (SELECT source AS "show" FROM ann WHERE contains(lower(main_topic), 'um') OR contains(lower(target_group), 'um') ORDER BY doc_id LIMIT 50)
SELECT 'transcript' AS kind, "show", count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'keyword', "show", count(*) FROM b GROUP BY ALL UNION ALL SELECT 'annotation', "show", count(*) FROM c GROUP BY ALL"""
