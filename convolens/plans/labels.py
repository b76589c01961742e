"""Queries on classifier labels."""

from __future__ import annotations

from convolens.operators import labels as L
from convolens.plans.base import CLS, cls, div
from convolens.session import table

QUERIES, ORACLE = {}, {}
MODELS = ["explicit_content", "fine_grained_hate_speech_detection", "hate_against_minorities", "hate_speech_detection", "hostile_content"]
_docs = lambda spark, d: table(spark, d, "documents")

_VOTE = "CASE WHEN model_name = 'hate_against_minorities' THEN CASE WHEN label = 'toxic' AND coalesce(confidence, 0) >= 0.5 THEN -1 ELSE 1 END " + " ".join(f"WHEN model_name = '{m}' AND label = '{x}' THEN {v}" for m, x, v in L.POLARITY) + " ELSE 0 END"
_AD = "coalesce(model_name = 'ad_content_detection' AND label = 'LABEL_1', false)"
_DOC = f"""{CLS}, vt AS (SELECT doc_id, bool_or({_AD}) AS is_ad, count(*) FILTER ({_VOTE} = 1) AS p, count(*) FILTER ({_VOTE} = -1) AS n FROM cls GROUP BY 1),
dv AS (SELECT doc_id, is_ad, CASE WHEN is_ad THEN 0 ELSE p END AS positive, CASE WHEN is_ad THEN 0 ELSE n END AS negative FROM vt),
dl AS (SELECT *, CASE WHEN positive + negative = 0 THEN 'UNKNOWN' WHEN positive >= negative THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label FROM dv)"""

QUERIES["label_distribution"] = lambda spark, d: L.label_distribution(cls(spark, d))
ORACLE["label_distribution"] = f"""WITH {CLS}, g AS (SELECT model_name, label, count(*) AS n FROM cls WHERE model_name IS NOT NULL AND label IS NOT NULL GROUP BY ALL)
SELECT *, round(n * 100 / sum(n) OVER w, 2) AS pct, count(*) OVER w AS n_labels FROM g WINDOW w AS (PARTITION BY model_name)"""
QUERIES["confidence_histogram"] = lambda spark, d: L.confidence_histogram(cls(spark, d))
ORACLE["confidence_histogram"] = f"""WITH {CLS}, g AS (SELECT model_name, least(floor(confidence * 10), 9) AS bin, count(*) AS n FROM cls WHERE confidence IS NOT NULL GROUP BY ALL)
SELECT m.model_name, CAST(b.bin AS INT) AS bin, coalesce(g.n, 0) AS n, printf('%.2f-%.2f', b.bin / 10.0, (b.bin + 1) / 10.0) AS range
FROM (SELECT DISTINCT model_name FROM cls WHERE model_name IS NOT NULL) m CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN g ON g.model_name = m.model_name AND g.bin = b.bin"""
QUERIES["model_agreement"] = lambda spark, d: L.model_agreement(cls(spark, d), ["hate_speech_detection", "hostile_content", "fine_grained_hate_speech_detection"])
ORACLE["model_agreement"] = f"""WITH {CLS}, v AS (SELECT doc_id, count(DISTINCT model_name) AS m, count(DISTINCT {_VOTE}) AS k FROM cls WHERE model_name IN ('hate_speech_detection', 'hostile_content', 'fine_grained_hate_speech_detection') GROUP BY 1),
g AS (SELECT count(*) FILTER (m = 3) AS n_complete, count(*) FILTER (m = 3 AND k = 1) AS n_agree FROM v), t AS (SELECT count(DISTINCT doc_id) AS n_documents FROM cls)
SELECT n_documents, n_complete, n_agree, round({div("n_agree * 100", "n_documents")}, 2) AS agreement_pct FROM t, g"""
QUERIES["label_matrix"] = lambda spark, d: L.label_matrix(cls(spark, d), MODELS)
ORACLE["label_matrix"] = f"WITH {CLS} SELECT doc_id, " + ", ".join(f"max(label) FILTER (model_name = '{m}') AS {m}_label" for m in MODELS) + ", " + ", ".join(f"printf('%.4f', max(confidence) FILTER (model_name = '{m}')) AS {m}_confidence" for m in MODELS) + " FROM cls GROUP BY doc_id"
QUERIES["document_labels"] = lambda spark, d: L.document_votes(cls(spark, d))
ORACLE["document_labels"] = f"WITH {_DOC} SELECT * FROM dl"
QUERIES["show_labels"] = lambda spark, d: L.show_votes(cls(spark, d), _docs(spark, d))
ORACLE["show_labels"] = f"""WITH {_DOC}, s AS (SELECT source, grouping(source) AS is_total, count(*) FILTER (label = 'POSITIVE') AS n_positive, count(*) FILTER (label = 'NEGATIVE') AS n_negative, count(*) FILTER (label = 'UNKNOWN') AS n_unknown,
  count(*) FILTER (is_ad) AS n_ads, sum(positive) AS positive, sum(negative) AS negative FROM dl JOIN documents USING (doc_id) GROUP BY ROLLUP (source))
SELECT *, CASE WHEN n_positive + n_negative = 0 THEN 'UNKNOWN' WHEN n_positive >= n_negative THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label FROM s"""
QUERIES["label_tally"] = lambda spark, d: L.label_tally(cls(spark, d))
ORACLE["label_tally"] = f"""WITH {CLS} SELECT model_name, CASE WHEN model_name = 'hate_against_minorities' AND label = 'toxic' THEN CASE WHEN coalesce(confidence, 0) >= 0.5 THEN 'toxic (high conf)' ELSE 'toxic (low conf)' END ELSE label END AS label, count(*) AS n
FROM cls WHERE label IS NOT NULL GROUP BY ALL"""
QUERIES["classification_rollup"] = lambda spark, d: L.classification_rollup(cls(spark, d), _docs(spark, d))
ORACLE["classification_rollup"] = f"""WITH {CLS}, j AS (SELECT source, episode_id, model_name, label FROM cls JOIN documents USING (doc_id) WHERE model_name IS NOT NULL AND label IS NOT NULL)
SELECT 'all' AS level, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS episode_id, model_name, label, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'show', source, NULL, model_name, label, count(*) FROM j GROUP BY ALL
UNION ALL SELECT 'episode', source, episode_id, model_name, label, count(*) FROM j GROUP BY ALL"""
QUERIES["corpus_statistics"] = lambda spark, d: L.corpus_statistics(cls(spark, d), _docs(spark, d))
ORACLE["corpus_statistics"] = f"""WITH {CLS} SELECT count(DISTINCT source) AS n_shows, count(DISTINCT episode_id) AS n_episodes, count(*) AS n_documents, (SELECT count(DISTINCT doc_id) FROM cls) AS n_classified, (SELECT count(DISTINCT model_name) FROM cls) AS n_models FROM documents"""
QUERIES["show_coverage"] = lambda spark, d: L.show_coverage(_docs(spark, d))
ORACLE["show_coverage"] = f"""WITH g AS (SELECT source, count(DISTINCT episode_id) AS n_episodes, count(*) AS n_documents FROM documents GROUP BY 1)
SELECT *, round({div("n_documents", "n_episodes")}, 2) AS per_episode, row_number() OVER (ORDER BY n_episodes DESC, source) AS rank FROM g"""
_SENT = f"""{CLS}, f AS (SELECT doc_id, model_name = 'hostile_content' AND label = 'OFFENSIVE' AS hostile, model_name = 'hate_against_minorities' AND label IN ('toxic', 'severe_toxic', 'obscene', 'threat', 'insult', 'identity_hate') AS toxic,
  model_name = 'hate_speech_detection' AND label = 'HATE' AS hate, model_name = 'hate_speech_detection' AND label = 'NOT-HATE' AS safe FROM cls),
ds AS (SELECT doc_id, count(*) FILTER (hostile) AS n_hostile, count(*) FILTER (toxic) AS n_toxic, CASE WHEN coalesce(bool_or(hostile OR toxic OR hate), false) THEN 'negative' WHEN coalesce(bool_or(safe), false) THEN 'positive' ELSE 'neutral' END AS sentiment FROM f GROUP BY 1)"""
QUERIES["document_sentiment"] = lambda spark, d: L.document_sentiment(cls(spark, d))
ORACLE["document_sentiment"] = f"WITH {_SENT} SELECT * FROM ds"
QUERIES["sentiment_by_show"] = lambda spark, d: L.sentiment_by_show(cls(spark, d), _docs(spark, d))
ORACLE["sentiment_by_show"] = f"""WITH {_SENT} SELECT source, count(*) AS n_documents, count(*) FILTER (sentiment = 'negative') AS n_negative, count(*) FILTER (sentiment = 'positive') AS n_positive, count(*) FILTER (sentiment = 'neutral') AS n_neutral,
  sum(n_hostile) AS n_hostile, round(sum(n_hostile) * 100 / count(*), 2) AS hostile_pct FROM ds JOIN documents USING (doc_id) GROUP BY 1"""
QUERIES["problematic_flags"] = lambda spark, d: L.problematic_flags(cls(spark, d), _docs(spark, d))
ORACLE["problematic_flags"] = f"""WITH {CLS} SELECT source, model_name, label, count(*) AS n FROM cls JOIN documents USING (doc_id) WHERE regexp_matches(lower(label), 'hate|toxic|hostile|offensive') GROUP BY ALL"""
QUERIES["llm_gate"] = lambda spark, d: L.annotation_gate(cls(spark, d))
ORACLE["llm_gate"] = f"""WITH {CLS}, g AS (SELECT doc_id, bool_or({_AD}) AS is_ad, count(*) FILTER ({_VOTE} = -1) AS n_negative FROM cls GROUP BY 1)
SELECT *, NOT is_ad AND n_negative >= 2 AS annotate, CASE WHEN is_ad THEN 'advertisement' WHEN n_negative < 2 THEN 'insufficient_negative_labels' END AS skip_reason FROM g"""
QUERIES["missing_models"] = lambda spark, d: L.missing_models(cls(spark, d), _docs(spark, d), MODELS)
ORACLE["missing_models"] = f"""WITH {CLS}, x AS (SELECT d.doc_id, m.model_name FROM documents d CROSS JOIN (SELECT unnest([{", ".join(repr(m) for m in MODELS)}]) AS model_name) m WHERE NOT EXISTS (SELECT 1 FROM cls c WHERE c.doc_id = d.doc_id AND c.model_name = m.model_name))
SELECT doc_id, string_agg(model_name, ',' ORDER BY model_name) AS missing FROM x GROUP BY 1"""


def _split(spark, d):
    c = cls(spark, d)
    return c.where("doc_id % 2 = 0"), c.where("doc_id % 3 = 0").selectExpr("doc_id", "model_name", "concat('new ', label) as label", "confidence")


QUERIES["merged_classifications"] = lambda spark, d: L.merged(*_split(spark, d))
ORACLE["merged_classifications"] = f"""WITH {CLS}, b AS (SELECT *, 0 AS v FROM cls WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, model_name, 'new ' || label, confidence, 1 FROM cls WHERE doc_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, model_name ORDER BY v DESC) AS r FROM b) SELECT doc_id, model_name, label, confidence FROM r WHERE r = 1"""
QUERIES["top_labels"] = lambda spark, d: L.top_labels(cls(spark, d))
_TOP = "g AS (SELECT model_name, label, count(*) AS n FROM cls WHERE label IS NOT NULL {0} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY n DESC, label) AS rank FROM g) SELECT * FROM r WHERE rank <= 10"
ORACLE["top_labels"] = f"WITH {CLS}, " + _TOP.format("")
QUERIES["top_unsafe_labels"] = lambda spark, d: L.top_labels(cls(spark, d), without_safe=True)
ORACLE["top_unsafe_labels"] = f"WITH {CLS}, " + _TOP.format("AND upper(label) NOT IN ('LABEL_0', 'NOT-HATE', 'SAFE', 'APPROPRIATE')")
QUERIES["coverage_crosscheck"] = lambda spark, d: L.coverage_check(cls(spark, d), _docs(spark, d), len(MODELS))
ORACLE["coverage_crosscheck"] = f"""WITH {CLS}, n AS (SELECT doc_id, count(DISTINCT model_name) AS k FROM cls GROUP BY 1),
j AS (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'text' END AS tx, CASE WHEN coalesce(k, 0) = 0 THEN 'none' WHEN k >= 5 THEN 'complete' ELSE 'some' END AS labels FROM documents LEFT JOIN n USING (doc_id))
SELECT coalesce(tx, 'all') AS text, coalesce(labels, 'all') AS labels, count(*) AS n FROM j GROUP BY CUBE (tx, labels)"""
