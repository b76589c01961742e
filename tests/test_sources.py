import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from convolens import session
from convolens.functions import models as P
from convolens.operators import coverage, segments as B
from convolens.plans import registry
from convolens.sources import readers as R, report, writers as O
from convolens.streaming import online


@pytest.fixture()
def root(tmp_path):
    files = {
        "show a/e1": {"segments": [{"text": "hi", "start": 0, "end": 1.5, "speaker": "A", "odd": 1, "classifications": [{"model_name": "m", "label": "x", "confidence": 0.5}]}, {"text": "bad", "start": 3, "end": 2}, {"text": "null", "start": 2, "end": 3, "speaker": None}]},
        "show a/e2": {"transcription": {"segments": [{"text": "deep", "start": 0, "end": 1}]}}, "b/e3": {"text": "only text"}, "b/e4": {"segments": []}, "b/e5": {"full_text": "full", "metadata": {"language": "en"}},
    }
    for name, data in files.items():
        f = tmp_path / "in" / f"{name}.json"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(data, indent=1))
    (tmp_path / "in" / "b" / "broken.json").write_text('{"segments": [')
    (tmp_path / "in" / "b" / "x.rttm").write_text("SPEAKER f 1 5.000 1.500 <NA> <NA> S1 <NA> <NA>\nSPEAKER f 1 0.250 2.000 <NA> <NA> S0 <NA> <NA>\nLEXEME f 1 1 1 a b c\nSPEAKER f 1 x\n\nSPEAKER f 1 bad 1 <NA> <NA> S1 <NA> <NA>\n")
    return tmp_path


def test_transcripts(spark, root):
    t = R.read_transcripts(spark, str(root / "in"))
    assert t.count() == 6 and [r.episode_id for r in R.corrupt_files(t).collect()] == ["broken"]
    s = R.explode_segments(t)
    got = sorted((r.show, r.episode_id, r.segment_id, r.text, r.speaker) for r in s.collect() if r.episode_id != "e1")
    assert got == [("b", "e3", 0, "only text", None), ("b", "e5", 0, "full", None), ("show a", "e2", 0, "deep", None)]
    assert sorted(r.segment_id for r in s.where("episode_id = 'e1'").collect()) == [0, 2]
    assert [tuple(r) for r in R.classifications(s).collect()] == [("show a", "e1", 0, "m", "x", 0.5)]
    with pytest.raises(Exception, match="invalid segment"):
        R.explode_segments(t, strict=True).collect()


def test_rttm(spark, root, tmp_path):
    t = R.read_rttm(spark, str(root / "in"))
    assert [tuple(r) for r in t.orderBy("turn_ord").collect()] == [("b", "x", 0, 0.25, 2.25, "S0"), ("b", "x", 1, 5.0, 6.5, "S1")]
    assert O.rttm_lines(t).orderBy("value").first().value == "SPEAKER x 1 0.250 2.000 <NA> <NA> S0 <NA> <NA>"
    O.write_rttm(t, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>
    <item><title>Old</title><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><enclosure url="http://x/a.mp3" type="audio/mpeg" length="12"/><itunes:duration>1:02:03</itunes:duration></item>
    <item><title>New</title><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate><link>http://x/b.mp3</link></item><item><title>No audio</title></item>
    <item><title>Undated</title><guid>g3</guid><enclosure url="http://x/c" type="audio/ogg" length="x"/><itunes:episode>7</itunes:episode></item></channel></rss>""")
    e = R.read_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(r.title, r.duration, r.episode_number, r.file_size) for r in e] == [("New", None, None, None), ("Old", 3723, None, 12), ("Undated", None, 7, None)]
    assert len(e[0].episode_id) == 16


def test_features_and_folders(spark, tmp_path, root):
    df = spark.createDataFrame([("s", "e", 1.5, "x")], "show string, episode_id string, a double, b string")
    O.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in R.read_features(spark, str(tmp_path / "csv"), ["a", "b"]).select("a", "b").collect()] == [(1.5, None)]
    assert {r.folder: r.n_files for r in R.folder_stats(spark, str(root / "in")).collect()} == {"show a": 2, "b": 5}


def test_folders_are_written_by_all_tasks(spark, data):
    n = len(registry.QUERIES["folders_counted"](spark, data).collect())
    files = [p for p in Path(session._open[-1].root.removeprefix("file://")).rglob("episode_id=*/*") if p.is_file()]
    assert len(files) == n and all(p.name.startswith("part-") for p in files)
    assert len({p.name[:10] for p in files}) == 4


def test_folder_stats_takes_few_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"e{i:02}").mkdir()
        (tmp_path / f"e{i:02}" / "x.txt").write_text("x" * (i + 1))
    key, group, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "folder_stats", spark.sparkContext
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    sc.setJobGroup(group, group)
    try:
        got = [tuple(r) for r in R.folder_stats(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == [(f"e{i:02}", 1, i + 1) for i in range(40)] and spark.conf.get(key) == before
    status = sc.statusTracker()
    tasks = [s.numTasks for j in status.getJobIdsForGroup(group) for i in status.getJobInfo(j).stageIds if (s := status.getStageInfo(i))]
    assert tasks and max(tasks) <= 4


def test_audio_kind(spark):
    rows = [(bytearray(b"ID3\x04abcdefgh"),), (bytearray(b"OggSxxxxxxxx"),), (bytearray(b"\0\0\0\x20ftypM4A "),), (bytearray(b"hello world!"),), (bytearray(),)]
    assert [r[0] for r in spark.createDataFrame(rows, "c binary").select(R.audio_kind(F.col("c"))).collect()] == ["mp3", "ogg", "m4a", None, None]


def test_lexicon(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text(json.dumps({"categories": {"a": {"high_confidence": ["x"], "exploratory": ["y", "z"]}}}))
    assert [tuple(r) for r in R.read_lexicon(spark, str(p)).orderBy("ord").collect()] == [(0, "a", "high_confidence", "x"), (1, "a", "exploratory", "y"), (2, "a", "exploratory", "z")]
    with pytest.raises(ValueError):
        R.lexicon_rows({"categories": {"a": {}}})


def test_report(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, y int")
    text = report.comprehensive("T", {"S": df})
    assert "| a\\|b | 1 |" in text and "## S" in text and json.loads(report.as_json({"S": df}))["S"][0]["y"] == 1


def test_models(spark):
    df = spark.createDataFrame([(1, "a text"), (2, "  "), (3, None)], "i int, text string")

    class Fails:
        name = "f"

        def classify(self, texts):
            raise RuntimeError

    got = {r.i: r for r in P.annotate(P.embed(P.classify(df, [P.HashClassifier("m", ["x", "y"]), Fails()]), P.HashEncoder(3)), P.HashAnnotator(), F.lit(True)).collect()}
    assert [len(got[i].classifications) for i in (1, 2, 3)] == [1, 0, 0] and all(len(got[i].embedding) == 3 for i in got)
    assert got[1].annotation.main_topic and got[2].annotation is None


def test_streams(spark, tmp_path):
    s = spark.createDataFrame([("e", i, ["A", "A", "B", None, "A"][i], None) for i in range(5)], "episode_id string, segment_id int, speaker string, x string")
    for k, part in enumerate((s.where("segment_id < 3"), s.where("segment_id >= 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = []
        online.run_available(online.online_turns(online.stream_table(spark, str(tmp_path / "in"), s)), lambda df, _: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"), "update")
        assert seen == [[("e", 2, 3)], [("e", 4, 5)]][k]


def test_pending_and_stored(spark):
    a = spark.createDataFrame([("s", "e1"), ("t", "e1")], "show string, episode_id string")
    assert [tuple(r) for r in coverage.pending(a, a.where("show = 's'"), ["show", "episode_id"]).collect()] == [("t", "e1")]
    assert coverage.with_stored(a.limit(1), a, ["show", "episode_id"]).count() == 2
    assert B.valid_segments(spark.createDataFrame([(0, 1), (2, 1), (-1, 3)], "start_ms int, end_ms int")).count() == 1
