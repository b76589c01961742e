"""Queries of this subpackage, by name, and the SQL each is checked with where SQL can express it."""

from __future__ import annotations

from convolens.llm import langid, packing, runs, sentences, spans, tokenizer, toxicity, transcripts

QUERIES, ORACLE = {}, {}

QUERIES["p1_found"] = transcripts.p1_found
QUERIES["p1_turns"] = transcripts.p1_turns
QUERIES["p4_found"] = langid.p4_found
QUERIES["p4_documents"] = langid.p4_documents
QUERIES["p4_segments"] = langid.p4_segments
QUERIES["p5_found"] = toxicity.p5_found
QUERIES["p5_scores"] = toxicity.p5_scores
QUERIES["p5_sources"] = toxicity.p5_sources
QUERIES["p6_found"] = spans.p6_found
QUERIES["p6_shares"] = spans.p6_shares
QUERIES["p6_members"] = spans.p6_members
QUERIES["p7_ids"] = tokenizer.p7_ids
QUERIES["p7_lengths"] = tokenizer.p7_lengths
ORACLE["p7_lengths"] = "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes FROM documents"
QUERIES["p8_kept"] = packing.p8_kept
ORACLE["p8_kept"] = "SELECT container, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_overfull, 0 AS n_split, 0 AS n_lost FROM capacities WHERE capacity_tokens > 0 AND container IS NOT NULL"
QUERIES["p8_pack"] = packing.p8_pack
QUERIES["p8_fill"] = packing.p8_fill
QUERIES["p9_covered"] = sentences.p9_covered
ORACLE["p9_covered"] = """SELECT doc_id, length(regexp_replace(text, '[\\s\\pZ\\x{0B}\\x{85}\\x{FEFF}\\x{200B}]', '', 'g')) AS n_chars FROM documents WHERE regexp_matches(text, '[^\\s\\pZ\\x{0B}\\x{85}\\x{FEFF}\\x{200B}]')"""
QUERIES["p9_found"] = sentences.p9_found
QUERIES["p9_sentences"] = sentences.p9_sentences
QUERIES["p3_found"] = runs.p3_found
ORACLE["p3_found"] = """
WITH d AS (
  SELECT episode_id, segment_id, "start" AS a, "end" AS b, speaker,
         row_number() OVER (PARTITION BY episode_id, segment_id ORDER BY ingested_at DESC NULLS LAST, "start" DESC NULLS LAST, "end" DESC NULLS LAST, speaker DESC NULLS LAST) AS r
  FROM segments),
k AS (
  SELECT episode_id, segment_id, CAST(round(a * 1000) AS BIGINT) AS s, CAST(round(b * 1000) AS BIGINT) AS e,
         trim(regexp_replace(strip_accents(lower(coalesce(speaker, ''))), '[^a-z0-9а-яё]+', ' ', 'g')) AS x
  FROM d WHERE r = 1 AND a IS NOT NULL AND b IS NOT NULL AND b >= a),
l AS (
  SELECT *, CASE WHEN x IN ('', 'unknown') THEN '?'
                 WHEN regexp_matches(x, '^((speaker|spk|s) ?)?[0-9]+$') THEN '#' || CAST(CAST(regexp_extract(x, '([0-9]+)$', 1) AS INT) AS VARCHAR)
                 ELSE x END AS lab FROM k),
n AS (SELECT *, lag(lab) OVER w AS before, row_number() OVER w AS pos FROM l WINDOW w AS (PARTITION BY episode_id ORDER BY s, e, segment_id)),
t AS (SELECT DISTINCT episode_id, lab AS third FROM l WHERE NOT regexp_matches(lab, '^[#?]')),
c AS (
  SELECT n.*, CASE
    WHEN before IS NULL THEN 1
    WHEN before = lab THEN 0
    WHEN regexp_matches(lab, '^[#?]') OR regexp_matches(before, '^[#?]') OR length(lab) < 4 OR length(before) < 4 THEN 1
    WHEN damerau_levenshtein(lab, before) <= 1 THEN 0
    WHEN levenshtein(lab, before) = 2 AND EXISTS (SELECT 1 FROM t WHERE t.episode_id = n.episode_id AND levenshtein(t.third, n.lab) <= 1 AND levenshtein(t.third, n.before) <= 1) THEN 0
    ELSE 1 END AS new FROM n),
g AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
SELECT episode_id, arg_min(segment_id, pos) AS first_segment_id, count(*) AS n_segments, max(e) - min(s) AS duration_ms
FROM g GROUP BY episode_id, run HAVING count(*) >= 2
"""
