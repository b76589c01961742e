from pyspark.sql import functions as F

from convolens.functions import fuzzy as Z
from convolens.operators import derived as D, names as N


def test_roles(spark):
    e = spark.createDataFrame([("e", "The Ada_Byron Hour", "With Bob Gray", "Hi, I'm Cy Dorn and my name is Eve Fox", "Kit Lane", ["Kit Lane", "Ada Byron", "Bob Gray", "Cy Dorn", "Zed Ymir"]), ("f", "Show", None, "I'm Cy Dorn. I'm Eve Fox", None, ["Cy Dorn", "Eve Fox"]), ("g", None, None, None, None, [])], "episode_id string, show_title string, title string, intro string, known_host string, names array<string>")
    got = {(r.episode_id, r.name): (r.role, r.confidence, r.reason) for r in N.heuristic_roles(e).collect()}
    assert got == {
        ("e", "Kit Lane"): ("HOST", 0.95, "known host"), ("e", "Ada Byron"): ("GUEST", 0.5, "default"), ("e", "Bob Gray"): ("GUEST", 0.75, "in episode title"), ("e", "Cy Dorn"): ("GUEST", 0.7, "self-introduction"), ("e", "Zed Ymir"): ("GUEST", 0.5, "default"),
        ("f", "Cy Dorn"): ("HOST", 0.7, "self-introduction"), ("f", "Eve Fox"): ("GUEST", 0.7, "self-introduction"),
    }
    assert {r.name: r.role for r in N.fallback_roles(e).collect() if r.episode_id == "e"}["Ada Byron"] == "HOST"


def test_introductions_and_merging(spark):
    t = spark.createDataFrame([("e", "Welcome. My name is Ada Q. Byron and Joining us is Bob X. Gray."), ("e", "no names at all"), ("e", None)], "k string, text string")
    # a plain first and last name doesn't fit the patterns: the middle initial is needed
    assert {(r.name, r.pattern_no) for r in N.introduced_names(t, ["k"]).collect()} == {("Ada Q. Byron", 0), ("Bob X. Gray", 2)}
    n = spark.createDataFrame([("e", "Ada Byron", "pattern", 0.85, 5), ("e", "ada byron", "ner", 0.7, 2), ("e", "Bob Gray", "ner", 0.7, 9)], "k string, name string, method string, confidence double, position int")
    got = {r.name: (r.method, r.confidence, r.position) for r in N.distinct_names(n, ["k"]).collect()}
    assert got == {"ada byron": ("combined", 0.85, 2), "Bob Gray": ("ner", 0.7, 9)}


def test_video_confidence(spark):
    d = spark.createDataFrame([("big news day", 100, "The Show", "the show: big news day", "x", 105), ("big news day", 100, "The Show", "other", "y", 120), ("big news day", 0, "The Show", "news", "the show", None)], "a string, b int, c string, d string, e string, f int")
    got = [round(r[0], 4) for r in d.select(Z.video_confidence(*(F.col(c) for c in "abcdef"))).collect()]
    assert got == [1.0, 0.1, 0.5333]


def test_metadata_and_matches(spark):
    e = spark.createDataFrame([("1", "Ann Lee", "Bo Ray", ["Cy Dee"]), ("2", " ", "Bo Ray", None), ("3", None, None, ["Cy Dee", "Di Fox"]), ("4", None, None, None)], "episode_id string, feed_author string, known_host string, file_names array<string>")
    got = {r.episode_id: (r.host, r.guests, r.source, r.confidence) for r in D.episode_metadata(e).collect()}
    assert got == {"1": ("Ann Lee", ["Cy Dee"], "feed", 0.9), "2": ("Bo Ray", [], "known_host", 0.8), "3": ("Cy Dee", ["Di Fox"], "filename", 0.5), "4": (None, [], "none", 0.3)}
    q = spark.createDataFrame([("daily news",), ("zzz",)], "query string")
    t = spark.createDataFrame([("daily news",), ("daily mews",), ("x",)], "target string")
    assert [tuple(r) for r in D.best_match(q, t).collect()] == [("daily news", "daily news", 1.0)]
    assert D.rank_results(q, t, 1).count() == 2


def test_error_categories(spark):
    d = spark.createDataFrame([("Read timed out",), ("SSL error",), ("404",), ("odd",), (None,)], "x string")
    assert [r[0] for r in d.select(Z.error_category(F.col("x"))).collect()] == ["timeout", "network", "not_found", "unknown", "unknown"]
