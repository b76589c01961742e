"""Reports, configuration files, exact medians, lenient JSON, and the life of stages."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from convolens import session
from convolens.functions.jsonfix import parsed
from convolens.functions.text import paragraph
from convolens.operators import coverage, explore, names, reports
from convolens.sources import readers as R, writers as O


def test_medians(spark):
    r = random.Random(4)
    groups = {"a": [r.randint(-5000, 5000) for _ in range(501)], "b": [7] * 100 + [9] * 100, "c": [3], "d": [1, 10**12], "e": [r.choice([0, 1, 10**9]) for _ in range(400)]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x bigint")
    assert {x.k: x.median for x in explore.medians(df, ["k"]).collect()} == {k: statistics.median(xs) for k, xs in groups.items()}
    assert explore.medians(df.limit(0), ["k"]).count() == 0


def test_overview(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.5), ("b", None), ("b", -4.0)], "k string, m double")
    got = {x.k: tuple(x)[2:] for x in explore.overview_by(df, "k", ["m"]).collect()}
    assert got == {"a": (2, 2.0, 2.0, 0.707107, 1.5, 2.5, 1.0), "b": (1, -4.0, -4.0, None, -4.0, -4.0, 0.0)}


def test_label_report(spark):
    t = spark.createDataFrame([("m", "b|c", 1234), ("m", "a", 1), (None, None, 2)], "model_name string, label string, n bigint")
    lines = reports.label_report(t)
    text = [x.line for x in lines.where("model_name = 'm'").orderBy("line_no").collect()]
    assert text == ["**m** (total: 1,235)", "", "| Label | Count | Percentage |", "|-------|------:|------------|", "| a | 1 | 0.1% |", "| b|c | 1,234 | 99.9% |"]
    assert {tuple(x) for x in reports.read_label_report(lines).collect()} == {("m", "b|c", 1234), ("m", "a", 1), ("unknown", "unknown", 2)}
    assert reports.label_report(t.limit(0)).count() == 0


def test_annotation_report(spark):
    schema = "source string, has_hate_speech boolean, has_advertisement boolean, target_group string, hate_speech_type string"
    df = spark.createDataFrame([("a", True, False, "women", None), ("a", None, True, None, None), (None, False, False, None, None)], schema)
    text = [x.line for x in reports.annotation_report(df, files=1).orderBy("line_no").collect()]
    assert "| Hate Speech Rate | 33.33% |" in text and text[-2:] == ["- a: 2 segments annotated", "... and 1 more files"]
    assert "| Hate Speech Rate | 0.00% |" in [x.line for x in reports.annotation_report(df.limit(0)).collect()]
    assert [tuple(x) for x in reports.hate_report(df).orderBy("section").collect()] == [("source", 1, "a", 1, 100.0), ("target_group", 1, "women", 1, 100.0)]


def test_metric_table(spark):
    df = spark.createDataFrame([("s", 12345, None)], "show string, a bigint, b bigint")
    lines = reports.metric_table(df, "show", {"a": "Total a", "b": "Total b"})
    assert {tuple(x) for x in reports.read_metric_table(lines, "show").collect()} == {("s", "Total a", 12345), ("s", "Total b", 0)}


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"models": [{"name": "m", "model_repo": "r", "labels": ["x", 1]}]}))
    assert [tuple(x) for x in R.read_classifiers(spark, str(tmp_path / "c.json")).collect()] == [(0, "m", "r", ["x", "1"])]
    for bad in ({"models": []}, {"models": [{"name": "m", "labels": ["x"]}]}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            R.read_classifiers(spark, str(tmp_path / "bad.json"))
    (tmp_path / "t.json").write_text(json.dumps({"target_groups": [{"id": "g"}, {"id": "h"}], "strategies": [{"id": "s", "description": "d", "examples": {"g": ["one", "two"]}}]}))
    groups, strategies, examples = R.read_taxonomy(spark, str(tmp_path / "t.json"))
    assert (groups.count(), strategies.count(), examples.count()) == (2, 1, 2)
    (tmp_path / "e.json").write_text(json.dumps({"target_groups": [{"id": "g"}], "strategies": []}))
    with pytest.raises(ValueError):
        R.read_taxonomy(spark, str(tmp_path / "e.json"))


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "l.yaml").write_text("categories:\n  a:\n    high_confidence: [x]\n    exploratory:\n      - y\n")
    assert [tuple(x) for x in R.read_lexicon(spark, str(tmp_path / "l.yaml")).collect()] == [(0, "a", "high_confidence", "x"), (1, "a", "exploratory", "y")]


def test_lenient_json():
    cases = {
        "{'main_topic': 'the host's dog', }": "the host's dog", '{main_topic: "a\nb"}': "a\nb", '{"main_topic": "\\u00e9\\"x"}': 'é"x', '{"x": [1, -2.5, None, {y: True}], "main_topic": "m"}': "m",
    }
    for answer, topic in cases.items():
        assert parsed(answer)["main_topic"] == topic and parsed(answer)["error"] is None
    for answer in ('{"a" 1}', "{'main_topic': maybe}", "{" * 3000 + "}" * 3000, '{"a": "b}'):
        assert parsed(answer)["error"]


def test_paragraph(spark):
    df = spark.createDataFrame([("aaa  bb\n c",), ("x" * 9,), (None,), ("",)], "t string")
    assert [x[0] for x in df.select(paragraph(F.col("t"), 4)).collect()] == ["aaa\nbb c", "xxxx\nxxxx\nx", "", ""]


def test_resumed(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "k int")
    partial = spark.createDataFrame([(1, "old"), (4, "old")], "k int, v string")
    got = coverage.resumed(items, partial, "k", lambda rest: rest.withColumn("v", F.lit("new"))).collect()
    assert {x.k: x.v for x in got} == {0: "new", 1: "old", 2: "new", 3: "new", 4: "old", 5: "new"}


def test_host_rank_of_a_show_decides(spark):
    roles = spark.createDataFrame([("e", 0, "Ann Bee", "HOST", 0.9, "r")], "episode_id string, ord int, name string, role string, confidence double, reason string")
    seg = spark.createDataFrame([("s", "e", i, sp, "talk", i * 10, i * 10 + n) for i, (sp, n) in enumerate([("A", 9), ("B", 5), ("C", 2)])], "show string, episode_id string, segment_id int, speaker string, text string, start_ms bigint, end_ms bigint")
    ranks = names.show_host_ranks(spark.createDataFrame([("s", 1, 0.8), ("t", 0, 0.4)], "show string, rank int, score double"), spark.createDataFrame([("e", "s"), ("f", "t")], "episode_id string, show string"))
    assert [tuple(x) for x in ranks.collect()] == [("e", 1)]
    assert [(x.speaker, x.method) for x in names.names_to_speakers(roles, seg, ranks).collect()] == [("B", "cross_episode_pattern")]
    assert [(x.speaker, x.method) for x in names.names_to_speakers(roles, seg).collect()] == [("A", "speaking_time_rank")]


def test_names_by_speaker(spark):
    seg = spark.createDataFrame([("e", 0, "A", "My name is Ann B. Cole and Ann B. Cole here"), ("e", 1, "B", "This is Ann B. Cole"), ("e", 2, "B", None)], "episode_id string, segment_id int, speaker string, text string")
    got = {(x.speaker, x.name, x.method, x.position) for x in names.names_by_speaker(seg).collect()}
    assert got == {("A", "Ann B. Cole", "combined", 0), ("B", "Ann B. Cole", "pattern_0", 1)}


def test_match_files(spark, tmp_path):
    m = spark.createDataFrame([("s", 'e"1', 3, "A", 61000, 62000, "um", "filler", "exploratory", "Um", 4, "well ", " yes")], "show string, episode_id string, segment_id int, speaker string, start_ms bigint, end_ms bigint, keyword string, category string, tier string, matched_text string, position int, context_before string, context_after string")
    O.write_matches(m, str(tmp_path / "m"))
    assert [(x.episode_id, x.keyword, x.position) for x in R.read_matches(spark, str(tmp_path / "m")).collect()] == [('e"1', "um", 4)]
    assert O.match_lines(m).first().line == "[00:01:01] A: well [Um] yes"


def test_stages_are_released(spark):
    from pathlib import Path

    with session.releasing():
        stage = session.Stage(spark, "t")
        kept = stage.keep(spark.range(3))
        folder = Path(stage.root.removeprefix("file:"))
        assert kept.count() == 3 and folder.exists()
    assert not folder.exists()


def test_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake)


def test_failures_of_models_are_told(spark):
    from convolens.functions import models as P

    class Fails:
        name = "f"

        def classify(self, texts):
            raise RuntimeError

    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, text string")
    got = P.classify(df, [P.HashClassifier("m", ["x"]), Fails()], errors="errors").collect()
    assert all([(e.model_name, e.error) for e in r.errors] == [("f", "RuntimeError")] for r in got) and {len(r.classifications) for r in got} == {0, 1}


@pytest.mark.parametrize("block", [1000, 2])
def test_similarities(spark, monkeypatch, block):
    from convolens.operators import embeddings as V

    monkeypatch.setattr(V, "BLOCK", block)
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(90, [0.0] * 4), (91, None), (92, [1.0]), (93, [1.0, None, 0.0, 0.0])]
    tax = [(f"t{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(5)] + [("zero", [0.0] * 4), ("none", None)]
    got = {(x.vec_id, x.label): x.similarity for x in V.threshold_matches(spark.createDataFrame(vectors, "vec_id int, embedding array<float>"), spark.createDataFrame(tax, "label string, vector array<double>"), 0.2).collect()}
    size = lambda v: sum(x * x for x in v) ** 0.5
    want = {(i, t): sum(a * b for a, b in zip(v, u)) / size(v) / size(u) for i, v in vectors[:50] for t, u in tax[:5]}
    assert got.keys() == {k for k, s in want.items() if s >= 0.2} and all(abs(s - want[k]) < 1e-5 for k, s in got.items())


def test_recognised_names(spark):
    from convolens.functions import models as P

    df = spark.createDataFrame([("e", "so " * 30 + "Ann Bee met Bob Cee Dee."), ("f", None)], "k string, text string")
    got = [tuple(x) for x in P.recognised_names(df, P.CapitalNames(), ["k"]).orderBy("position").collect()]
    assert [(k, n, p, c) for k, n, p, c, _ in got] == [("e", "Ann Bee", 90, 0.7), ("e", "Bob Cee Dee", 102, 0.7)] and got[0][4].startswith("o so") and got[0][4].endswith("Dee.")


def test_tasks(spark):
    from convolens.functions import models as P

    order = P.tasks({"tasks": {"b": {"depends_on": ["a"], "labels": ["Yes", "No"], "min_words": 2, "max_words": 3}, "a": {}}})
    assert [t.name for t in order] == ["a", "b"] and P.tasks({}) == []
    with pytest.raises(ValueError):
        P.tasks({"tasks": {"a": {"depends_on": ["b"]}, "b": {"depends_on": ["a"]}}})
    df = spark.createDataFrame([("one", "yes "), ("one two", "maybe"), ("one two three four", None), (None, "NO")], "t string, l string")
    got = df.select(P.wanted_by(order[1], F.col("t")), P.valid_label(order[1], F.col("l")), P.wanted_by(order[0], F.col("t"))).collect()
    assert [tuple(x) for x in got] == [(False, "Yes", True), (True, None, True), (False, None, True), (False, "No", False)]


def test_problems_of_answers(spark):
    from convolens.functions.jsonfix import problems_of

    df = spark.createDataFrame([('x {"a": true, "b": "t", "c": [1], "n": 1.5} y',), ('{"a": 1, "b": null, "c": {}, "n": "1"}',), ("none",), (None,), ("{",)], "t string")
    got = [x[0] for x in df.select(problems_of(F.col("t"), {"a": "boolean", "b": "string", "c": "array", "n": "number"})).collect()]
    assert got == [[], ["a: no boolean", "b: missing", "c: no array", "n: no number"], ["no JSON"], ["no JSON"], ["no JSON"]]
