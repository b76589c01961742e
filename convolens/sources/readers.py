"""Transcripts, turns, features, feeds and configuration from files, as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convolens.functions.numbers import parse_duration
from convolens.operators.feeds import episode_key, is_audio

WORD = "struct<word:string,start:double,end:double,score:double>"
CLASSIFICATION = "struct<model_name:string,label:string,confidence:double>"
ANNOTATION = "struct<has_hate_speech:boolean,has_advertisement:boolean,target_group:string,hate_speech_type:string,main_topic:string,error:string,skipped:boolean,skip_reason:string>"
SEGMENT = f"struct<text:string,start:double,end:double,speaker:string,speaker_name:string,words:array<{WORD}>,classifications:array<{CLASSIFICATION}>,embedding:array<float>,llm_annotation:{ANNOTATION}>"
METADATA = "struct<audio_file:string,language:string,duration:double,model:string,diarization_file:string,diarization_applied:boolean>"
#: Schema of a transcript file; fields it lacks are null.
TRANSCRIPT = f"audio_file string, language string, text string, full_text string, title string, show_name string, metadata {METADATA}, segments array<{SEGMENT}>, transcription struct<segments:array<{SEGMENT}>,full_text:string>, _corrupt string"


def _place(path: Column) -> tuple[Column, Column]:
    """Show and episode of <root>/<show>/<episode>.json, or of <root>/show=<show>/episode_id=<episode>/<any> as the writers make it."""
    parts = F.split(path, "/")
    # folder names are escaped once by the writer, and paths once more
    named = lambda key: F.nullif(F.url_decode(F.url_decode(F.regexp_replace(F.regexp_extract(path, f"/{key}=([^/]*)/", 1), r"\+", "%2B"))), F.lit(""))
    show = F.when(F.contains(path, F.lit("/episode_id=")), named("show")).otherwise(F.url_decode(F.element_at(parts, -2)))
    return show, F.coalesce(named("episode_id"), F.regexp_replace(F.url_decode(F.element_at(parts, -1)), r"\.[^.]*$", ""))


def read_transcripts(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """One row a file: show, episode_id, the file's fields, and _corrupt for files that are no JSON."""
    reader = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive)
    df = reader.json(root)
    show, episode = _place(F.col("_metadata.file_path"))
    return df.select("*", show.alias("show"), episode.alias("episode_id"))


def corrupt_files(transcripts: DataFrame) -> DataFrame:
    """Files that are no JSON, for a quarantine table."""
    return transcripts.where("_corrupt is not null and segments is null").select("show", "episode_id", "_corrupt")


def explode_segments(transcripts: DataFrame, strict: bool = False) -> DataFrame:
    """One row a segment, numbered from 0; a file without segments but with text is one segment.

    Segments may lie under ``transcription``. Strict: a segment that ends before its start, or at a negative time, is
    an error; else such segments are dropped.
    """
    t = transcripts.where("_corrupt is null")
    alone = F.when(F.coalesce("text", "full_text", "transcription.full_text").isNotNull(), F.array(F.from_json(F.to_json(F.struct(F.coalesce("text", "full_text", "transcription.full_text").alias("text"))), SEGMENT)))
    segs = F.coalesce("segments", "transcription.segments", alone)
    s = t.select("show", "episode_id", F.posexplode(segs).alias("segment_id", "s")).select("show", "episode_id", "segment_id", "s.*")
    bad = (F.coalesce("start", F.lit(0.0)) < 0) | (F.coalesce("end", F.lit(0.0)) < 0) | (F.col("end") < F.col("start"))
    bad = F.coalesce(bad, F.lit(False))
    return s.withColumn("text", F.when(F.assert_true(~bad, F.lit("invalid segment")).isNull(), F.col("text"))) if strict else s.where(~bad)


def classifications(segments: DataFrame) -> DataFrame:
    """(show, episode_id, segment_id, model_name, label, confidence)."""
    return segments.select("show", "episode_id", "segment_id", F.inline("classifications"))


def annotations(segments: DataFrame) -> DataFrame:
    return segments.where("llm_annotation is not null").select("show", "episode_id", "segment_id", "llm_annotation.*")


def read_rttm(spark: SparkSession, root: str) -> DataFrame:
    """Diarization turns: (show, episode_id, turn_ord, start, end, speaker) of SPEAKER lines with eight fields or more."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{rttm,txt}").text(root)
    show, episode = _place(F.col("_metadata.file_path"))
    p = lines.select(show.alias("show"), episode.alias("episode_id"), F.monotonically_increasing_id().alias("_i"), F.split(F.trim("value"), r"\s+").alias("p")).where("size(p) >= 8 and p[0] = 'SPEAKER'")
    p = p.select("show", "episode_id", "_i", F.col("p")[3].try_cast("double").alias("start"), F.col("p")[4].try_cast("double").alias("_d"), F.col("p")[7].alias("speaker")).where("start is not null and _d is not null")
    from pyspark.sql import Window as W

    ord_ = F.row_number().over(W.partitionBy("show", "episode_id").orderBy("start", "_i")) - 1
    return p.select("show", "episode_id", ord_.alias("turn_ord"), "start", (F.col("start") + F.col("_d")).alias("end"), "speaker")


def read_features(spark: SparkSession, path: str, metrics: list[str] | None = None) -> DataFrame:
    """A feature table from CSV with a header; the named metrics as numbers (null where they are none)."""
    df = spark.read.option("header", True).csv(path)
    return df if metrics is None else df.withColumns({m: F.nullif(F.trim(m), F.lit("")).try_cast("double") for m in metrics if m in df.columns})


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of RSS files: items with audio, newest first, undated ones last."""
    schema = "title string, link string, guid string, pubDate string, description string, enclosure struct<_url:string,_type:string,_length:string>, `itunes:duration` string, `itunes:episode` string, `itunes:season` string"
    items = spark.read.format("xml").option("rowTag", "item").option("recursiveFileLookup", True).schema(schema).load(path)
    url = F.col("enclosure._url")
    audio = F.when(is_audio(url, F.col("enclosure._type")), url).otherwise(F.when(is_audio(F.col("link"), F.lit(None).cast("string")), F.col("link")))
    published = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.col("pubDate")))
    e = items.select(
        episode_key(F.col("guid"), audio, F.col("title"), F.col("link")).alias("episode_id"), "title", audio.alias("audio_url"), published.alias("published"), parse_duration(F.col("`itunes:duration`")).alias("duration"),
        "description", F.col("`itunes:episode`").try_cast("int").alias("episode_number"), F.col("`itunes:season`").try_cast("int").alias("season_number"), F.col("enclosure._length").try_cast("bigint").alias("file_size"), F.col("enclosure._type").alias("mime_type"),
    )
    return e.where("audio_url is not null").orderBy(F.desc_nulls_last("published"), "episode_id")


def read_podcasts(spark: SparkSession, path: str) -> DataFrame:
    """(title, description, author, website, language) of the channels of RSS files."""
    schema = "title string, description string, `itunes:author` string, link string, language string"
    c = spark.read.format("xml").option("rowTag", "channel").option("recursiveFileLookup", True).schema(schema).load(path)
    return c.select("title", "description", F.col("`itunes:author`").alias("author"), F.col("link").alias("website"), "language")


def discover_shows(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(show, path) of all files below a folder, a show being a folder of files; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    show, episode = _place(F.col("path"))
    return f.select(show.alias("show"), episode.alias("episode_id"), "path").orderBy("show", "path")


def folder_stats(spark: SparkSession, root: str) -> DataFrame:
    """(folder, n_files, bytes) of all files below a folder, by name; contents aren't read.

    Folders are listed and files looked at in as many tasks as a shuffle has: Spark's own choice, up to 10000 tasks to
    list and one for a few files each, takes longer to start the tasks than to do the work.
    """
    n, key = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, n)  # load lists the files at once
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    finally:
        spark.conf.set(key, before)
    f = files.select("path", "length").coalesce(int(n))
    return f.groupBy(F.url_decode(F.element_at(F.split("path", "/"), -2)).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes")).orderBy("folder")


AUDIO_SIGNATURES = {"mp3": ["494433", "FFFB", "FFF3", "FFF2"], "ogg": ["4F676753"], "wav": ["52494646"], "flac": ["664C6143"]}


def audio_kind(content: Column) -> Column:
    """The kind of audio its first bytes tell (m4a has them after four), null if none."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.substring(head, 9, 8) == "66747970", F.lit("m4a"))
    for kind, starts in AUDIO_SIGNATURES.items():
        for s in starts:
            out = out.when(head.startswith(s), F.lit(kind))
    return out


def lexicon_rows(config: dict) -> list[tuple]:
    """(ord, category, tier, keyword) of a lexicon {category: {high_confidence: [...], exploratory: [...]}}."""
    rows = []
    for category, tiers in config["categories"].items():
        if not isinstance(tiers, dict) or not any(tiers.get(t) for t in ("high_confidence", "exploratory")):
            raise ValueError(f"category {category!r} has no keywords")
        for tier in ("high_confidence", "exploratory"):
            rows += [(len(rows) + i, category, tier, k) for i, k in enumerate(tiers.get(tier) or [])]
    return rows


def _config(spark: SparkSession, path: str) -> dict:
    """A configuration file, YAML (where the library is there) or JSON, on any file system; it is small and read whole."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def read_classifiers(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, model_repo, labels) of {models: [{name, model_repo, labels}]}; each needs a name, a repository and labels."""
    rows = []
    for i, m in enumerate(_config(spark, path).get("models") or []):
        lacking = [k for k in ("name", "model_repo", "labels") if not m.get(k)]
        if lacking:
            raise ValueError(f"model {m.get('name', i)!r} lacks {', '.join(lacking)}")
        rows.append((i, m["name"], m["model_repo"], [str(x) for x in m["labels"]]))
    if not rows:
        raise ValueError("no models")
    return spark.createDataFrame(rows, "ord int, name string, model_repo string, labels array<string>")


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, strategies, examples) as taxonomy_texts wants them, of {target_groups: [{id}], strategies: [{id, description, examples: {group: [...]}}]}."""
    config = _config(spark, path)
    groups, strategies = config.get("target_groups") or [], config.get("strategies") or []
    if not groups or not strategies:
        raise ValueError("a taxonomy needs target groups and strategies")
    examples = [(g, s["id"], i, str(x)) for s in strategies for g, xs in (s.get("examples") or {}).items() for i, x in enumerate(xs)]
    make = spark.createDataFrame
    return make([(g["id"],) for g in groups], "id string"), make([(s["id"], s.get("description") or "") for s in strategies], "id string, description string"), make(examples, "target_group_id string, strategy_id string, ord int, item string")


def read_matches(spark: SparkSession, root: str) -> DataFrame:
    """Keyword matches out of the files of write_matches: (episode_id, keyword, matched_text, position, segment_id, speaker, start_ms, category, tier)."""
    one = "struct<keyword:string,matched_text:string,context_before:string,context_after:string,position:int,segment_id:int,speaker:string,start_ms:bigint,category:string,tier:string>"
    lines = spark.read.schema(f"episode_id string, match_count bigint, matches array<{one}>").json(root)
    return lines.select("episode_id", F.inline("matches"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from a YAML or JSON configuration file (a fixed dimension, read by the driver)."""
    rows = lexicon_rows(_config(spark, path))
    return spark.createDataFrame(rows, "ord int, category string, tier string, keyword string")
