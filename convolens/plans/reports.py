"""Queries on reports, read-backs of reports, speakers' appearances, resumed work and wrapped text."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from convolens.functions import text as T
from convolens.operators import coverage as C, feeds as D, labels as L, reports as R, speakers as S
from convolens.plans.base import CLS, SEG, cls, seg
from convolens.plans.labels import ORACLE as _LABELS
from convolens.plans.search import _ANN, ann
from convolens.plans.speakers import _EP, _SPK
from convolens.session import Stage, table

QUERIES, ORACLE = {}, {}
_tally = lambda spark, d: L.label_tally(cls(spark, d))
_TALLY = f"t AS (SELECT coalesce(model_name, 'unknown') AS model_name, label, sum(n) AS n FROM ({_LABELS['label_tally']}) GROUP BY 1, 2)"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', floor(coalesce(CAST({part} AS DOUBLE) * {100 * 10**digits} / nullif({whole}, 0), 0) + 0.5) / {10**digits}) || '%'"


QUERIES["label_report"] = lambda spark, d: R.label_report(_tally(spark, d))
ORACLE["label_report"] = f"""WITH {_TALLY}, w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY model_name) AS BIGINT) AS total, row_number() OVER (PARTITION BY model_name ORDER BY label) AS no FROM t)
SELECT model_name, CAST(no + 3 AS INT) AS line_no, '| ' || label || ' | ' || format('{{:,}}', CAST(n AS BIGINT)) || ' | ' || {pct("n", "total")} || ' |' AS line FROM w
UNION ALL SELECT model_name, 0, '**' || model_name || '** (total: ' || format('{{:,}}', total) || ')' FROM w WHERE no = 1 UNION ALL SELECT model_name, 1, '' FROM w WHERE no = 1
UNION ALL SELECT model_name, 2, '| Label | Count | Percentage |' FROM w WHERE no = 1 UNION ALL SELECT model_name, 3, '|-------|------:|------------|' FROM w WHERE no = 1"""


def label_report_read(spark, d):
    """The report of every model as a file, read back into counts."""
    root = Stage(spark, "report").root
    R.label_report(_tally(spark, d)).repartition("model_name").sortWithinPartitions("model_name", "line_no").select("model_name", "line").write.mode("overwrite").partitionBy("model_name").text(root)
    return R.read_label_report(spark.read.text(root).withColumnRenamed("value", "line"))


QUERIES["label_report_read"] = label_report_read
ORACLE["label_report_read"] = f"WITH {_TALLY} SELECT model_name, label, n FROM t"
_rank = lambda keys, value, source: f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {value}) AS rank, {value}, count(*) AS n, floor(count(*) * 10000 / sum(count(*)) OVER (PARTITION BY {keys}) + 0.5) / 100 AS pct FROM {source} GROUP BY {keys}, {value}"""
QUERIES["hate_report"] = lambda spark, d: R.hate_report(ann(spark, d))
ORACLE["hate_report"] = f"""WITH {_ANN}, l AS (SELECT 'target_group' AS section, target_group AS value FROM ann WHERE has_hate_speech UNION ALL SELECT 'hate_speech_type', hate_speech_type FROM ann WHERE has_hate_speech UNION ALL SELECT 'source', source FROM ann WHERE has_hate_speech),
v AS (SELECT * FROM l WHERE value IS NOT NULL) {_rank("section", "value", "v")}"""
QUERIES["classification_summary"] = lambda spark, d: R.classification_summary(cls(spark, d))
ORACLE["classification_summary"] = f"""WITH {CLS}, v AS (SELECT * FROM cls WHERE model_name IS NOT NULL AND label IS NOT NULL) {_rank("model_name", "label", "v")}"""
QUERIES["annotation_report"] = lambda spark, d: R.annotation_report(ann(spark, d))
ORACLE["annotation_report"] = f"""WITH {_ANN}, p AS (SELECT coalesce(source, 'unknown') AS source, count(*) AS n, count(*) FILTER (has_hate_speech) AS hate, count(*) FILTER (has_advertisement) AS ads FROM ann GROUP BY 1),
t AS (SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hate) AS BIGINT) AS hate, CAST(sum(ads) AS BIGINT) AS ads FROM p)
SELECT 0 AS line_no, '| Metric | Value |' AS line UNION ALL SELECT 1, '|--------|-------|' UNION ALL SELECT 2, '| Total Files | ' || files || ' |' FROM t UNION ALL SELECT 3, '| Total Segments | ' || format('{{:,}}', n) || ' |' FROM t
UNION ALL SELECT 4, '| Hate Speech Detected | ' || format('{{:,}}', hate) || ' |' FROM t UNION ALL SELECT 5, '| Advertisements Detected | ' || format('{{:,}}', ads) || ' |' FROM t
UNION ALL SELECT 6, '| Hate Speech Rate | ' || {pct("hate", "n", 2)} || ' |' FROM t UNION ALL SELECT 7, '| Advertisement Rate | ' || {pct("ads", "n", 2)} || ' |' FROM t
UNION ALL SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY source) + 99 AS INT), '- ' || source || ': ' || n || ' segments annotated' FROM p ORDER BY source LIMIT 20)
UNION ALL SELECT 120, '... and ' || (files - 20) || ' more files' FROM t WHERE files > 20"""
_METRICS = {"n_episodes": "Total episodes", "n_segments": "Total segments", "n_words": "Total words"}
_totals = lambda spark, d: S.podcast_totals(seg(spark, d)).where("is_total = 0")
_TOTALS = f"""{_EP}, s AS (SELECT "show", count(*) AS n_episodes, CAST(sum(n_segments) AS BIGINT) AS n_segments, CAST(sum(n_words) AS BIGINT) AS n_words FROM ep GROUP BY 1)"""
QUERIES["show_markdown"] = lambda spark, d: R.metric_table(_totals(spark, d), "show", _METRICS)
ORACLE["show_markdown"] = f"""WITH {_TOTALS} SELECT "show", 0 AS line_no, '# Show Summary: ' || "show" AS line FROM s UNION ALL SELECT "show", 1, '' FROM s UNION ALL SELECT "show", 2, '| Metric | Value |' FROM s UNION ALL SELECT "show", 3, '|--------|-------|' FROM s
""" + " ".join(f"""UNION ALL SELECT "show", {4 + i}, '| {t} | ' || format('{{:,}}', {c}) || ' |' FROM s""" for i, (c, t) in enumerate(_METRICS.items()))
QUERIES["show_markdown_read"] = lambda spark, d: R.read_metric_table(R.metric_table(_totals(spark, d), "show", _METRICS), "show")
ORACLE["show_markdown_read"] = f"WITH {_TOTALS} " + " UNION ALL ".join(f"""SELECT "show", '{t}' AS metric, {c} AS value FROM s""" for c, t in _METRICS.items())
QUERIES["appearances"] = lambda spark, d: S.appearances(seg(spark, d))
ORACLE["appearances"] = f"""WITH {SEG}, g AS (SELECT "show", episode_id, speaker, min(segment_id) AS first_segment, max(segment_id) AS last_segment, arg_min(start_ms, segment_id) AS first_ms, arg_max(end_ms, segment_id) AS last_ms FROM seg GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY first_segment, speaker) AS ord FROM g"""


def resumed(spark, d):
    """Word counts of segments: half of them there from before, the rest counted now."""
    s = seg(spark, d).withColumn("key", F.concat_ws("/", "episode_id", "segment_id"))
    count = lambda df, how: df.select("key", T.count_words(F.col("text")).alias("n_words"), F.lit(how).alias("run"))
    return C.resumed(s, count(s.where("segment_id % 2 = 0"), "before"), "key", lambda rest: count(rest, "now"))


QUERIES["changed_files"] = lambda spark, d: C.changed(table(spark, d, "episodes").select("audio_url", "fetched_at"), table(spark, d, "episodes").where("season_number = 1").select("audio_url", "fetched_at"), "audio_url", "fetched_at").select("audio_url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched"))
ORACLE["changed_files"] = """SELECT audio_url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM episodes k WHERE k.season_number = 1 AND k.audio_url = e.audio_url AND k.fetched_at = e.fetched_at)"""
QUERIES["resumed"] = resumed
ORACLE["resumed"] = f"""WITH {SEG} SELECT episode_id || '/' || segment_id AS key, len(regexp_extract_all(text, '[^\\x09-\\x0D\\x1C-\\x20\\x85\\pZ]+')) AS n_words, CASE WHEN segment_id % 2 = 0 THEN 'before' ELSE 'now' END AS run FROM seg"""
QUERIES["paragraphs"] = lambda spark, d: seg(spark, d).select("episode_id", "segment_id", T.paragraph(F.col("text"), 40).alias("text"))
ORACLE["paragraphs"] = f"""WITH {SEG}, f AS (SELECT episode_id, segment_id, trim(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x85\\pZ]+', ' ', 'g')) AS x FROM seg)
SELECT episode_id, segment_id, regexp_replace(regexp_replace(x, '(.{{1,40}})(?: |$)|(.{{40}})', '\\1\\2' || chr(10), 'g'), chr(10) || '$', '') AS text FROM f"""
QUERIES["shows_in_genre"] = lambda spark, d: D.in_genre(table(spark, d, "shows"), "EN", "language").select("show", "language")
ORACLE["shows_in_genre"] = """SELECT "show", language FROM shows WHERE contains(lower(language), 'en')"""


def comprehensive_report(spark, d):
    totals = _totals(spark, d).select("show", "n_episodes", "n_segments", "n_words")
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_words"), "show"))).select("rank", "show", "n_words")
    labels = R.classification_summary(cls(spark, d)).select("model_name", "rank", "label", "n")
    flags = L.problematic_flags(cls(spark, d), table(spark, d, "documents"))
    return R.comprehensive({"Corpus": (L.corpus_statistics(cls(spark, d), table(spark, d, "documents")), ["n_shows"]), "Shows": (totals, ["show"]), "Ranking": (ranked, ["rank"]), "Labels": (labels, ["model_name", "rank"]), "Problematic content": (flags, ["source", "model_name", "label"])})


def _section(no: int, name: str, columns: list[str], query: str, order: str) -> str:
    head = [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    cells = " || ' | ' || ".join(f"coalesce(replace(CAST({c} AS VARCHAR), '|', '\\|'), '')" for c in ('"show"' if c == "show" else c for c in columns))
    return " UNION ALL ".join(f"SELECT {no} AS section_no, '{name}' AS section, {i} AS line_no, '{x}' AS line" for i, x in enumerate(head)) + f" UNION ALL SELECT {no}, '{name}', CAST(row_number() OVER (ORDER BY {order}) + 3 AS INT), '| ' || {cells} || ' |' FROM ({query})"


QUERIES["comprehensive_report"] = comprehensive_report
ORACLE["comprehensive_report"] = " UNION ALL ".join([
    _section(0, "Corpus", ["n_shows", "n_episodes", "n_documents", "n_classified", "n_models"], _LABELS["corpus_statistics"], "n_shows"),
    _section(1, "Shows", ["show", "n_episodes", "n_segments", "n_words"], f"WITH {_TOTALS} SELECT * FROM s", '"show"'),
    _section(2, "Ranking", ["rank", "show", "n_words"], f"""WITH {_TOTALS} SELECT row_number() OVER (ORDER BY n_words DESC, "show") AS rank, * FROM s""", "rank"),
    _section(3, "Labels", ["model_name", "rank", "label", "n"], ORACLE["classification_summary"], "model_name, rank"),
    _section(4, "Problematic content", ["source", "model_name", "label", "n"], _LABELS["problematic_flags"], "source, model_name, label"),
])
QUERIES["speaker_share"] = lambda spark, d: R.speaker_share(S.speaker_stats(seg(spark, d)))
ORACLE["speaker_share"] = f"""WITH {_SPK}, g AS (SELECT "show", speaker, sum(n_words) AS n_words FROM spk GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY n_words DESC, speaker) AS r FROM g),
t AS (SELECT speaker, count(*) AS n_shows, CAST(sum(n_words) AS BIGINT) AS n_words FROM r WHERE r <= 10 GROUP BY 1) SELECT *, floor(coalesce(n_words * 10000 / nullif(sum(n_words) OVER (), 0), 0) + 0.5) / 100 AS pct FROM t"""
