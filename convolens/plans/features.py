"""Queries on conversation features."""

from __future__ import annotations

from convolens.functions import text as T
from convolens.operators import features as X
from convolens.plans.base import SEG, SPACE, div, seg

QUERIES, ORACLE = {}, {}

_TT = f"""{SEG},
tf AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY episode_id ORDER BY segment_id) = speaker THEN 0 ELSE 1 END AS new FROM seg),
tb AS (SELECT "show", episode_id, speaker, sum(new) AS turns, sum(end_ms - start_ms) AS time_ms FROM tf GROUP BY ALL),
tt AS (SELECT "show", episode_id, list(time_ms ORDER BY time_ms DESC) AS t, sum(turns) AS total_turns, count(*) AS n_speakers FROM tb GROUP BY ALL),
tl AS (SELECT "show", episode_id, arg_max(end_ms, segment_id) AS duration_ms FROM seg GROUP BY ALL),
turn_taking AS (SELECT "show", episode_id, total_turns, n_speakers, round(duration_ms / 600, 0) / 100 AS duration_minutes, round({div("duration_ms", "total_turns * 6")}, 0) / 10000 AS avg_switch_minutes,
  round(CASE WHEN n_speakers = 1 THEN 1.0 ELSE {div("(t[1] - t[2])", "duration_ms")} END, 4) AS dominance_index FROM tt JOIN tl USING ("show", episode_id))"""
QUERIES["turn_taking"] = lambda spark, d: X.turn_taking(seg(spark, d))
ORACLE["turn_taking"] = f"WITH {_TT} SELECT * FROM turn_taking"
QUERIES["turn_taking_by_speaker"] = lambda spark, d: X.turn_taking_by_speaker(seg(spark, d))
ORACLE["turn_taking_by_speaker"] = f"""WITH {_TT} SELECT *, round({div("time_ms * 10", "turns")}, 0) / 10000 AS avg_turn_seconds FROM tb"""

_STOP = ", ".join("'" + w + "'" for w in T.STOPWORDS)
# a word is a run of a-z and apostrophes that begins with a letter or with apostrophes before one; words that other
# letters or digits touch drop out: they are marked first
_VOC = f"""{SEG},
vt AS (SELECT "show", episode_id, speaker, unnest(regexp_extract_all(lower(text), '[\\pL\\pN\\pM_'']+')) AS x FROM seg),
vw AS (SELECT "show", episode_id, speaker, regexp_replace(x, '^''+', '') AS word FROM vt WHERE regexp_full_match(x, '[a-z'']*[a-z][a-z'']*')),
vc AS (SELECT *, word NOT IN ({_STOP}) AS content FROM vw),
vb AS (SELECT "show", episode_id, word, content, count(*) AS n FROM vc GROUP BY ALL),
vg AS (SELECT "show", episode_id, sum(n) AS total_words, count(*) AS unique_words, coalesce(sum(n) FILTER (content), 0) AS total_words_no_stopwords, count(*) FILTER (content) AS unique_words_no_stopwords, count(*) FILTER (n = 1) AS hapax FROM vb GROUP BY ALL),
vocabulary AS (SELECT e."show", e.episode_id, coalesce(total_words, 0) AS total_words, coalesce(unique_words, 0) AS unique_words, coalesce(total_words_no_stopwords, 0) AS total_words_no_stopwords, coalesce(unique_words_no_stopwords, 0) AS unique_words_no_stopwords,
  round({div("unique_words", "total_words")}, 4) AS type_token_ratio, round(coalesce(unique_words / nullif(sqrt(total_words), 0), 0), 4) AS root_type_token_ratio, round({div("hapax", "unique_words")}, 4) AS hapax_ratio
  FROM (SELECT DISTINCT "show", episode_id FROM seg) e LEFT JOIN vg USING ("show", episode_id))"""
QUERIES["vocabulary"] = lambda spark, d: X.vocabulary(seg(spark, d))
ORACLE["vocabulary"] = f"WITH {_VOC} SELECT * FROM vocabulary"
QUERIES["vocabulary_by_speaker"] = lambda spark, d: X.vocabulary_by_speaker(seg(spark, d))
ORACLE["vocabulary_by_speaker"] = f"""WITH {_VOC} SELECT "show", episode_id, speaker, count(*) AS total_words, count(DISTINCT word) AS unique_words, round(count(DISTINCT word) / count(*), 4) AS type_token_ratio FROM vc GROUP BY ALL"""

_ISQ = f"""(regexp_matches(s, '\\?$') OR regexp_matches(s || ' ', '(?i)^(?:{"|".join(T.QUESTION_STARTERS)})[^\\pL\\pN_]'))"""
_PRON, _OPEN, _IMP = "|".join(w.replace("'", "''") for w in T.ADDRESS_PRONOUNS), "|".join(w.replace("'", "''") for w in T.ADDRESS_OPENERS), "|".join(T.ADDRESS_IMPERATIVES)
_ADDR = f"""(regexp_matches(' ' || s || ' ', '(?i)[^\\pL\\pN_](?:{_PRON})[^\\pL\\pN_]') OR regexp_matches(' ' || s || ' ', '(?i)[^\\pL\\pN_](?:{_OPEN})[\\s,;:—-]+you[^\\pL\\pN_]') OR regexp_matches(s || ' ', '(?i)^\\s*(?:{_IMP})[^\\pL\\pN_]'))"""
_Q = f"""{SEG},
qt AS (SELECT "show", episode_id, string_agg(text, ' ' ORDER BY segment_id) AS text, arg_max(end_ms, segment_id) AS duration_ms FROM seg GROUP BY ALL),
qs AS (SELECT "show", episode_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> '')) AS s FROM qt),
qf AS (SELECT *, {_ISQ} AS q, {_ADDR} AS a FROM qs),
qg AS (SELECT "show", episode_id, count(*) AS total_sentences, count(*) FILTER (q) AS total_questions, count(*) FILTER (q AND a) AS direct_address_count FROM qf GROUP BY ALL),
question_stats AS (SELECT qt."show", qt.episode_id, coalesce(total_sentences, 0) AS total_sentences, coalesce(total_questions, 0) AS total_questions, round({div("total_questions", "total_sentences")}, 4) AS question_ratio,
  round({div("total_questions * 60000", "duration_ms")}, 4) AS questions_per_minute, coalesce(direct_address_count, 0) AS direct_address_count, round({div("direct_address_count", "total_questions")}, 4) AS direct_address_ratio
  FROM qt LEFT JOIN qg USING ("show", episode_id))"""
QUERIES["question_stats"] = lambda spark, d: X.question_stats(seg(spark, d))
ORACLE["question_stats"] = f"WITH {_Q} SELECT * FROM question_stats"

_N = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9" + SPACE + "]', '', 'g'), '[" + SPACE + "]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_BEST = f"""{_Q},
qn AS (SELECT "show", episode_id, s AS question, row_number() OVER (PARTITION BY "show", episode_id ORDER BY i) - 1 AS question_no FROM (
  SELECT "show", episode_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT "show", episode_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> '') AS l FROM qt)) WHERE {_ISQ}),
qw AS (SELECT "show", episode_id, question_no, unnest({_N.format("question")}) AS word FROM qn),
sw AS (SELECT "show", episode_id, segment_id, unnest({_N.format("text")}) AS word FROM seg),
qc AS (SELECT "show", episode_id, question_no, segment_id, count(*) AS common FROM qw JOIN sw USING ("show", episode_id, word) GROUP BY ALL),
qb AS (SELECT *, row_number() OVER (PARTITION BY "show", episode_id, question_no ORDER BY common DESC, segment_id) AS r FROM qc),
best AS (SELECT "show", episode_id, question_no, segment_id, speaker, common FROM qb JOIN seg USING ("show", episode_id, segment_id) WHERE r = 1)"""
QUERIES["best_segment_match"] = lambda spark, d: X.best_segments(seg(spark, d), X.questions(seg(spark, d)))
ORACLE["best_segment_match"] = f"WITH {_BEST} SELECT * FROM best"
QUERIES["questions_by_speaker"] = lambda spark, d: X.questions_by_speaker(seg(spark, d))
ORACLE["questions_by_speaker"] = f"""WITH {_BEST} SELECT "show", episode_id, speaker, count(*) AS n_questions FROM best GROUP BY ALL"""


def _has(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def _person(k):
    return f"list_has_any(regexp_extract_all(lower(text), '[^{SPACE}]+'), [{', '.join(repr(w) for w in T.PERSONS[k])}])"


_STRIPPED = f"regexp_replace({{0}}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_SEEN = {
    "Gratitude": _has(T.GRATITUDE), "Please": "contains(lower(text), 'please')", "Please_start": f"starts_with({_STRIPPED.format('lower(text)')}, 'please')", "Apologizing": _has(T.APOLOGIES), "Hedges": _has(T.HEDGES),
    "Direct_question": f"ends_with({_STRIPPED.format('text')}, '?')", "2nd_person": _person("2nd_person"), "1st_person": _person("1st_person"), "1st_person_pl.": _person("1st_person_pl."),
}
_SCORE = f"(CAST({T.POLITENESS_BIAS} AS DOUBLE)" + "".join(f" + CASE WHEN {c} THEN CAST({T.POLITENESS[k]} AS DOUBLE) ELSE 0 END" for k, c in _SEEN.items()) + ")"
_POL = f"""{SEG},
pp AS (SELECT "show", episode_id, speaker, {_SCORE} AS p FROM seg WHERE regexp_matches(text, '[^{SPACE}]')),
pg AS (SELECT "show", episode_id, count(*) AS n_analyzed, round(avg(p), 4) AS average_politeness FROM pp GROUP BY ALL),
politeness AS (SELECT e."show", e.episode_id, coalesce(n_analyzed, 0) AS n_analyzed, coalesce(average_politeness, 0) AS average_politeness FROM (SELECT DISTINCT "show", episode_id FROM seg) e LEFT JOIN pg USING ("show", episode_id))"""
QUERIES["politeness"] = lambda spark, d: X.politeness(seg(spark, d))
ORACLE["politeness"] = f"WITH {_POL} SELECT * FROM politeness"
QUERIES["politeness_by_speaker"] = lambda spark, d: X.politeness_by_speaker(seg(spark, d))
ORACLE["politeness_by_speaker"] = f"""WITH {_POL} SELECT "show", episode_id, speaker, round(avg(p), 4) AS average_politeness FROM pp GROUP BY ALL"""
QUERIES["politeness_strategies"] = lambda spark, d: X.politeness_strategies(seg(spark, d))
ORACLE["politeness_strategies"] = f"""WITH {SEG}, x AS (SELECT * FROM seg WHERE regexp_matches(text, '[^{SPACE}]'))
""" + " UNION ALL ".join(f"""SELECT "show", episode_id, '{k}' AS strategy, count(*) AS n FROM x WHERE {c} GROUP BY ALL""" for k, c in _SEEN.items())


def _rest(name: str) -> str:
    """The CTEs of a feature group without the segments' own."""
    return {"q": _Q, "t": _TT, "v": _VOC, "p": _POL}[name][len(SEG) + 1 :]


QUERIES["episode_features"] = lambda spark, d: X.episode_features(seg(spark, d))
ORACLE["episode_features"] = f"""WITH {SEG}, {_rest("q")}, {_rest("t")}, {_rest("v")}, {_rest("p")}
SELECT * FROM question_stats JOIN turn_taking USING ("show", episode_id) JOIN vocabulary USING ("show", episode_id) JOIN politeness USING ("show", episode_id)"""

QUERIES["features_long"] = lambda spark, d: X.features_long(seg(spark, d))
ORACLE["features_long"] = f"""WITH {_BEST}, {_rest("t")}, {_rest("v")}, {_rest("p")},
a AS (SELECT *, round({div("time_ms * 10", "turns")}, 0) / 10000 AS avt FROM tb), b AS (SELECT "show", episode_id, speaker, count(*) AS tw, count(DISTINCT word) AS uw FROM vc GROUP BY ALL)
SELECT "show", episode_id, speaker, 'turns' AS metric, CAST(turns AS DOUBLE) AS value FROM a UNION ALL SELECT "show", episode_id, speaker, 'speaking_time', time_ms / 1000 FROM a
UNION ALL SELECT "show", episode_id, speaker, 'avg_turn_time', avt FROM a UNION ALL SELECT "show", episode_id, speaker, 'words', tw FROM b
UNION ALL SELECT "show", episode_id, speaker, 'unique_words', uw FROM b UNION ALL SELECT "show", episode_id, speaker, 'ttr', round(uw / tw, 4) FROM b
UNION ALL SELECT "show", episode_id, speaker, 'politeness', round(avg(p), 4) FROM pp GROUP BY ALL UNION ALL SELECT "show", episode_id, speaker, 'questions', count(*) FROM best GROUP BY ALL"""
