"""Queries that write files or streams and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.functions import models as P
from convolens.operators import features, keywords as K, labels as L
from convolens.plans.base import CLS, SEG, TURNS, cls, seg, turns
from convolens.plans.episodes import EPI, _ep
from convolens.plans.features import ORACLE as _FEATURES
from convolens.plans.keywords import _MATCH
from convolens.session import Stage, table
from convolens.sources import readers as R, writers as O
from convolens.streaming import online

QUERIES, ORACLE = {}, {}


def transcripts_round_trip(spark, d):
    """Segments as JSON, one file an episode, read back and taken apart again."""
    root = Stage(spark, "json").root
    s = seg(spark, d).select("show", "episode_id", "segment_id", "text", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker")
    O.write_transcripts(s, root)
    out = R.explode_segments(R.read_transcripts(spark, root))
    return out.select("show", "episode_id", "segment_id", "text", F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("end") * 1000).cast("bigint").alias("end_ms"), "speaker")


QUERIES["transcripts_round_trip"] = transcripts_round_trip
ORACLE["transcripts_round_trip"] = f"""WITH {SEG}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY segment_id) - 1 AS INT) AS i FROM seg)
SELECT "show", episode_id, i AS segment_id, text, start_ms, end_ms, speaker FROM n WHERE start_ms >= 0 AND end_ms >= 0 AND end_ms >= start_ms"""


def rttm_round_trip(spark, d):
    """Turns as RTTM, one file an episode, read back."""
    root = Stage(spark, "rttm").root
    O.write_rttm(turns(spark, d).select("episode_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker_id").alias("speaker")), root)
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint").alias(f"{c}_ms")
    return R.read_rttm(spark, root).select("episode_id", ms("start"), ms("end"), "speaker")


QUERIES["rttm_round_trip"] = rttm_round_trip
ORACLE["rttm_round_trip"] = f"WITH {TURNS} SELECT episode_id, start_ms, end_ms, speaker_id AS speaker FROM tur"


def features_csv(spark, d):
    root = Stage(spark, "csv").root
    f = features.turn_taking(seg(spark, d))
    O.write_csv(f, root, single=False)
    return R.read_features(spark, root, ["total_turns", "dominance_index"]).select("show", "episode_id", "total_turns", "dominance_index")


QUERIES["features_csv"] = features_csv
ORACLE["features_csv"] = f"""WITH f AS ({_FEATURES["turn_taking"]}) SELECT "show", episode_id, CAST(total_turns AS DOUBLE) AS total_turns, CAST(dominance_index AS DOUBLE) AS dominance_index FROM f"""


def matches_read_back(spark, d):
    """Keyword matches as files, read back."""
    root = Stage(spark, "matches").root
    O.write_matches(K.keyword_matches(seg(spark, d), table(spark, d, "lexicon")), root)
    return R.read_matches(spark, root)


QUERIES["matches_read_back"] = matches_read_back
ORACLE["matches_read_back"] = f"WITH {_MATCH} SELECT episode_id, keyword, matched_text, context_before, context_after, position, segment_id, speaker, start_ms, category, tier FROM m"
QUERIES["match_lines"] = lambda spark, d: O.match_lines(K.keyword_matches(seg(spark, d), table(spark, d, "lexicon")))
ORACLE["match_lines"] = f"""WITH {_MATCH} SELECT episode_id, segment_id, position, printf('[%02d:%02d:%02d]', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || ' ' || speaker || ': ' || context_before || '[' || matched_text || ']' || context_after AS line FROM m"""
QUERIES["category_export"] = lambda spark, d: O.category_export(K.keyword_matches(seg(spark, d), table(spark, d, "lexicon")))
ORACLE["category_export"] = f"WITH {_MATCH} SELECT row_number() OVER (ORDER BY count(*) DESC, category) AS rank, category, count(*) AS n FROM m GROUP BY category"
QUERIES["features_nested"] = lambda spark, d: O.nested_features(features.turn_taking(seg(spark, d)).select("show", "episode_id", "total_turns"), features.turn_taking_by_speaker(seg(spark, d)).select("show", "episode_id", "speaker", "turns")).select("episode_id", F.get_json_object("json", "$.total_turns").cast("bigint").alias("total_turns"), F.aggregate(F.map_values(F.from_json(F.get_json_object("json", "$.speakers"), "map<string,struct<turns:bigint>>")), F.lit(0).cast("bigint"), lambda a, x: a + x["turns"]).alias("turns"))
ORACLE["features_nested"] = f"""WITH {SEG}, f AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY episode_id ORDER BY segment_id) = speaker THEN 0 ELSE 1 END AS new FROM seg) SELECT episode_id, sum(new) AS total_turns, sum(new) AS turns FROM f GROUP BY episode_id"""


def lexicon_config(spark, d):
    """The lexicon as a configuration file, read back."""
    root = Stage(spark, "config").root
    t = table(spark, d, "lexicon").where("category is not null and tier in ('high_confidence', 'exploratory') and keyword is not null")
    words = lambda tier: F.array_sort(F.collect_list(F.when(F.col("tier") == tier, F.struct("ord", "keyword"))))
    g = t.groupBy("category").agg(words("high_confidence").alias("h"), words("exploratory").alias("e"))
    g = g.select("category", F.struct(F.transform("h", lambda x: x["keyword"]).alias("high_confidence"), F.transform("e", lambda x: x["keyword"]).alias("exploratory")).alias("t"))
    config = g.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "t")))).alias("categories"))).alias("value"))
    config.coalesce(1).write.mode("overwrite").text(root)
    return R.read_lexicon(spark, root)


QUERIES["lexicon_config"] = lexicon_config
ORACLE["lexicon_config"] = """SELECT CAST(row_number() OVER (ORDER BY category, tier <> 'high_confidence', ord) - 1 AS INT) AS ord, category, tier, keyword FROM lexicon WHERE category IS NOT NULL AND tier IN ('high_confidence', 'exploratory') AND keyword IS NOT NULL"""
QUERIES["matches_json"] = lambda spark, d: O.matches_envelope(K.keyword_matches(seg(spark, d), table(spark, d, "lexicon"))).select("episode_id", F.get_json_object("json", "$.match_count").cast("bigint").alias("match_count"), F.size(F.from_json(F.get_json_object("json", "$.matches"), "array<struct<keyword:string>>")).alias("n"), F.size(F.json_object_keys(F.get_json_object("json", "$.keyword_counts"))).alias("n_keywords"))
ORACLE["matches_json"] = f"WITH {_MATCH} SELECT episode_id, count(*) AS match_count, CAST(count(*) AS INT) AS n, CAST(count(DISTINCT keyword) AS INT) AS n_keywords FROM m GROUP BY 1"
_wide_speakers = ["SPEAKER_00", "SPEAKER_01"]
QUERIES["features_wide"] = lambda spark, d: O.wide_features(features.turn_taking(seg(spark, d)), features.features_long(seg(spark, d)), _wide_speakers).select("show", "episode_id", "total_turns", *(f"{m}_{s}" for s in _wide_speakers for m in ("turns", "words")))
ORACLE["features_wide"] = f"""WITH {SEG}, f AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY episode_id ORDER BY segment_id) = speaker THEN 0 ELSE 1 END AS new FROM seg),
w AS (SELECT "show", episode_id, speaker, unnest(regexp_extract_all(lower(text), '[\\pL\\pN\\pM_'']+')) AS x FROM seg), c AS (SELECT "show", episode_id, speaker, count(*) AS n FROM w WHERE regexp_full_match(x, '[a-z'']*[a-z][a-z'']*') GROUP BY ALL),
t AS (SELECT "show", episode_id, sum(new) AS total_turns, CAST(sum(new) FILTER (speaker = 'SPEAKER_00') AS DOUBLE) AS a, CAST(sum(new) FILTER (speaker = 'SPEAKER_01') AS DOUBLE) AS b FROM f GROUP BY ALL)
SELECT t."show", t.episode_id, total_turns, a AS "turns_SPEAKER_00", CAST(x.n AS DOUBLE) AS "words_SPEAKER_00", b AS "turns_SPEAKER_01", CAST(y.n AS DOUBLE) AS "words_SPEAKER_01"
FROM t LEFT JOIN c x ON x.episode_id = t.episode_id AND x.speaker = 'SPEAKER_00' LEFT JOIN c y ON y.episode_id = t.episode_id AND y.speaker = 'SPEAKER_01'"""


def stream_counts(spark, d):
    """Events counted per hour and type by a stream that reads all files there are, then ends."""
    stage = Stage(spark, "stream")
    events = table(spark, d, "events")
    events.select("event_id", "event_type", "ts").write.mode("overwrite").parquet(f"{stage.root}/in")
    s = online.stream_table(spark, f"{stage.root}/in", events.select("event_id", "event_type", "ts"))
    c = online.windowed_counts(s, "ts", "event_type")
    online.run_available(c, lambda df, _: df.write.mode("overwrite").parquet(f"{stage.root}/out"), f"{stage.root}/checkpoint", mode="complete")
    return spark.read.parquet(f"{stage.root}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


QUERIES["stream_hourly_counts"] = stream_counts
ORACLE["stream_hourly_counts"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"


def _streamed(spark, rows, name: str, plan, mode: str):
    """What a stream over all rows gives at its first and only trigger."""
    stage = Stage(spark, name)
    rows.write.mode("overwrite").parquet(f"{stage.root}/in")
    stream = online.stream_table(spark, f"{stage.root}/in", rows, files_per_trigger=1_000_000)
    online.run_available(plan(stream), lambda df, i: df.write.mode("append").parquet(f"{stage.root}/out"), f"{stage.root}/checkpoint", mode=mode)
    return spark.read.parquet(f"{stage.root}/out")


def stream_sessions(spark, d):
    """Sessions of users, ended by half an hour without events."""
    out = _streamed(spark, table(spark, d, "events").select("user_id", "ts"), "sessions", lambda s: online.sessions(s, "ts", "user_id"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES["stream_sessions"] = stream_sessions
ORACLE["stream_sessions"] = """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s"""
QUERIES["stream_turns"] = lambda spark, d: _streamed(spark, seg(spark, d).select("episode_id", "segment_id", "speaker"), "turns", online.online_turns, "update")
ORACLE["stream_turns"] = f"""WITH {SEG}, f AS (SELECT episode_id, CASE WHEN lag(speaker) OVER (PARTITION BY episode_id ORDER BY segment_id) = speaker THEN 0 ELSE 1 END AS new FROM seg)
SELECT episode_id, sum(new) AS turns, count(*) AS segments FROM f GROUP BY 1"""
QUERIES["stream_deliveries"] = lambda spark, d: _streamed(spark, table(spark, d, "segments").where("ingested_at is not null").select("episode_id", "segment_id", "ingested_at"), "deliveries", lambda s: online.distinct_deliveries(s, ["episode_id", "segment_id"]), "append").select("episode_id", "segment_id")
ORACLE["stream_deliveries"] = "SELECT DISTINCT episode_id, segment_id FROM segments WHERE ingested_at IS NOT NULL"


def stub_models(spark, d):
    """Gate, classifiers, annotator and encoder, with stand-in models, over the segments."""
    s = seg(spark, d).select("episode_id", "segment_id", "text")
    s = P.classify(s, [P.HashClassifier("a", ["x", "y"]), P.HashClassifier("b", ["HATE", "NOT-HATE"])])
    s = P.embed(s, P.HashEncoder(4))
    gate = F.exists("classifications", lambda c: c["label"] == "HATE")
    return P.annotate(s, P.HashAnnotator(), gate).select("episode_id", "segment_id", F.size("classifications").alias("n_labels"), F.size("embedding").alias("n_dims"), "annotation.has_hate_speech", "annotation.main_topic")


QUERIES["stub_models"] = stub_models
_unit = lambda salt: f"(CAST(('0x' || left(sha256('{salt}:' || text), 12)) AS UBIGINT) / 281474976710656e0)"
ORACLE["stub_models"] = f"""WITH {SEG}, u AS (SELECT episode_id, segment_id, regexp_matches(text, '[^\\x09-\\x0D\\x1C-\\x20\\x85\\pZ]') AS said, floor({_unit("b")} * 2) = 0 AS gate, {_unit("h")} > 0.9 AS hate, CAST(floor({_unit("t")} * 9) AS INT) AS topic FROM seg)
SELECT episode_id, segment_id, CASE WHEN said THEN 2 ELSE 0 END AS n_labels, 4 AS n_dims, CASE WHEN said AND gate THEN hate END AS has_hate_speech, CASE WHEN said AND gate THEN 'topic ' || topic END AS main_topic FROM u"""


def feed_round_trip(spark, d):
    """Shows and episodes as RSS, the episodes read back."""
    root = Stage(spark, "feed").root
    O.write_feed(table(spark, d, "shows"), _ep(spark, d), root)
    e = R.read_feed(spark, root)
    return e.select("episode_id", "audio_url", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), F.col("duration").cast("bigint").alias("duration"), "episode_number", "season_number", "file_size", "mime_type")


QUERIES["feed_round_trip"] = feed_round_trip
ORACLE["feed_round_trip"] = f"""WITH {EPI} SELECT episode_id, audio_url, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, duration, episode_number, season_number, file_size, mime_type FROM epi
WHERE "show" IN (SELECT "show" FROM shows) AND audio_url IS NOT NULL AND (coalesce(starts_with(mime_type, 'audio/'), false) OR regexp_matches(lower(audio_url), '\\.(?:mp3|m4a|ogg|wav)(?:[?#]|$)'))"""


def podcasts_round_trip(spark, d):
    root = Stage(spark, "podcasts").root
    O.write_feed(table(spark, d, "shows"), _ep(spark, d), root)
    return R.read_podcasts(spark, root).select("title", "author", "website", "language")


QUERIES["podcasts_round_trip"] = podcasts_round_trip
ORACLE["podcasts_round_trip"] = "SELECT title, author, website, language FROM shows"


def shows_found(spark, d):
    """The files of transcripts by show."""
    root = Stage(spark, "found").root
    O.write_transcripts(seg(spark, d).select("show", "episode_id", "segment_id", "text"), root)
    return R.discover_shows(spark, root).select("show", "episode_id")


QUERIES["shows_found"] = shows_found
ORACLE["shows_found"] = f"""WITH {SEG} SELECT DISTINCT "show", episode_id FROM seg"""


def folders_counted(spark, d):
    """Files below each folder of turns; their bytes depend on the writer, so only whether there are any is told."""
    root = Stage(spark, "folders").root
    O.write_rttm(turns(spark, d).select("episode_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker_id").alias("speaker")), root)
    f = R.folder_stats(spark, root).where("folder like 'episode_id=%'")
    return f.select(F.substring_index("folder", "=", -1).alias("episode_id"), (F.col("bytes") > 0).alias("filled")).distinct()


QUERIES["folders_counted"] = folders_counted
ORACLE["folders_counted"] = f"WITH {TURNS} SELECT DISTINCT episode_id, true AS filled FROM tur"
QUERIES["label_polarity"] = lambda spark, d: cls(spark, d).join(F.broadcast(L.polarity(spark)), ["model_name", "label"]).groupBy("model_name", "vote").agg(F.count("*").alias("n"))
ORACLE["label_polarity"] = f"WITH {CLS}, p AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{x}', {v})" for m, x, v in L.POLARITY) + ") t(model_name, label, vote)) SELECT cls.model_name, vote, count(*) AS n FROM cls JOIN p ON cls.model_name = p.model_name AND cls.label = p.label GROUP BY ALL"
