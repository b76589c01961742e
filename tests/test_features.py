import pytest
from pyspark.sql import functions as F

from conftest import rows
from convolens.functions import fuzzy as Z, jsonfix as J, numbers as N, text as T
from convolens.operators import features as X, keywords as K, labels as L, merge as M, names, segments as B, speakers as S, timeline as TL

RAW = "show string, episode_id string, segment_id int, text string, start double, end double, speaker string, speaker_name string, ingested_at timestamp_ntz"


def raw(spark, items):
    return spark.createDataFrame([("s", *i, None, None) for i in items], RAW)


@pytest.fixture(scope="module")
def one(spark):
    return B.current_segments(raw(spark, [
        ("e", 0, "Welcome to the show. How are you today?", 0.0, 4.0, "S0"), ("e", 1, "I think we should start.", 4.0, 5.0, "S0"), ("e", 2, "Thank you, maybe later.", 5.5, 9.5, "S1"),
        ("e", 3, None, 9.5, 10.0, "S1"), ("e", 4, "Please tell me why", 10.0, 12.0, "S0"), ("e", 5, "Is it sorry?", 12.0, 15.0, "S1"),
    ]))


def test_turn_taking(one):
    r = X.turn_taking(one).first()
    assert (r.total_turns, r.avg_switch_minutes, r.dominance_index) == (4, 0.0625, 0.0333)
    by = {x.speaker: x for x in X.turn_taking_by_speaker(one).collect()}
    assert (by["S0"].turns, by["S0"].time_ms, by["S0"].avg_turn_seconds) == (2, 7000, 3.5)
    assert (by["S1"].turns, by["S1"].time_ms, by["S1"].avg_turn_seconds) == (2, 7500, 3.75)


def test_merge(one):
    m = sorted(M.merge_consecutive(one).collect(), key=lambda r: r.run)
    assert [(r.speaker, r.start_ms, r.end_ms) for r in m][:2] == [("S0", 0, 5000), ("S1", 5500, 10000)]
    assert len(m) == 4 and m[1].text == "Thank you, maybe later. "
    assert M.merge_reduction(one).first().reduction == 2


def test_merge_is_idempotent(one):
    m = M.merge_consecutive(one).select("show", "episode_id", F.col("run").cast("int").alias("segment_id"), "text", "speaker", "start_ms", "end_ms", F.lit(None).cast("string").alias("speaker_name"))
    assert M.merge_reduction(m).first().reduction == 0


def test_speaker_stats(one):
    by = {r.speaker: r for r in S.speaker_stats(one).collect()}
    assert (by["S0"].n_words, by["S0"].word_pct, by["S1"].n_words, by["S1"].word_pct, by["S1"].n_segments) == (17, 70.83, 7, 29.17, 3)
    e = S.episode_stats(one).first()
    assert e.dominant_speaker == "S0" and e.n_words == 24


def test_questions(one):
    q = X.question_stats(one).first()
    assert (q.total_sentences, q.total_questions, q.question_ratio, q.questions_per_minute, q.direct_address_count, q.direct_address_ratio) == (5, 2, 0.4, 8.0, 1, 0.5)
    assert rows(X.questions_by_speaker(one)) == [("s", "e", "S0", 2)]


def test_vocabulary(one):
    v = X.vocabulary(one).first()
    assert (v.total_words, v.unique_words, v.type_token_ratio, v.root_type_token_ratio) == (24, 23, 0.9583, 4.6949)
    assert (v.total_words_no_stopwords, v.unique_words_no_stopwords) == (10, 10)


def test_politeness(one):
    got = [round(r.p, 6) for r in one.where("text != ''").orderBy("segment_id").select(T.politeness_score(F.col("text")).alias("p")).collect()]
    assert got == [-1.447058, 0.887072, 2.513572, -0.349788, 0.101412]
    assert X.politeness(one).first().average_politeness == 0.341
    assert {r.speaker: r.average_politeness for r in X.politeness_by_speaker(one).collect()} == {"S0": -0.3033, "S1": 1.3075}


def test_transitions(one):
    assert [r[2:5] for r in rows(S.transitions(one))] == [("S0", "S1", 2), ("S1", "S0", 1)]


def test_overlap(spark):
    s = B.current_segments(raw(spark, [("e", 0, "", 0.0, 10.0, "x"), ("e", 1, "", 10.0, 20.0, "x"), ("f", 0, "", 10.0, 20.0, "x"), ("g", 0, "", 0.0, 9.0, "x"), ("e", 2, "", 3.0, 3.0, "x")]))
    t = spark.createDataFrame([("e", 0, 0, 4000, "A"), ("e", 1, 4000, 8000, "B"), ("e", 2, 7000, 10000, "C"), ("e", 3, 10000, 10900, "D"), ("f", 0, 10000, 11000, "D")], "episode_id string, turn_ord int, start_ms bigint, end_ms bigint, speaker_id string")
    got = {(r.episode_id, r.segment_id): r.speaker for r in M.overlap_speakers(s, t).collect()}
    assert got == {("e", 0): "A", ("e", 1): "UNKNOWN", ("f", 0): "D", ("g", 0): "UNKNOWN", ("e", 2): "UNKNOWN"}


def cls(spark, items):
    return spark.createDataFrame(items, "doc_id bigint, model_name string, label string, confidence double")


def test_votes(spark):
    H, O, T_, FG = "hate_speech_detection", "hostile_content", "hate_against_minorities", "fine_grained_hate_speech_detection"
    c = cls(spark, [(1, H, "HATE", 1.0), (1, O, "OFFENSIVE", 1.0), (1, T_, "toxic", 0.49), (2, H, "NOT-HATE", 1.0), (2, FG, "LABEL_0", 1.0), (2, O, "NOT-OFFENSIVE", 1.0), (2, T_, "toxic", 0.5), (3, "ad_content_detection", "LABEL_1", 1.0), (3, H, "HATE", 1.0), (4, "other", "x", None), (5, H, "HATE", 1.0), (5, FG, "LABEL_0", None)])
    got = {r.doc_id: (r.positive, r.negative, r.label) for r in L.document_votes(c).collect()}
    assert got == {1: (1, 2, "NEGATIVE"), 2: (3, 1, "POSITIVE"), 3: (0, 0, "UNKNOWN"), 4: (0, 0, "UNKNOWN"), 5: (1, 1, "POSITIVE")}


def test_histogram(spark):
    c = cls(spark, [(i, "m", "x", v) for i, v in enumerate([0.0, 0.05, 0.1, 0.95, 1.0, None])])
    assert [r.n for r in L.confidence_histogram(c).orderBy("bin").collect()] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 2]


def test_agreement_needs_two(spark):
    with pytest.raises(ValueError):
        L.model_agreement(cls(spark, []), ["a"])


def test_trend(spark):
    d = spark.createDataFrame([("s", i, v) for i, v in enumerate([1, 0, 0, 2, 3])], "show string, i int, n bigint")
    r = TL.trend(d, "show", "i", "n").first()
    assert (r["first"], r["last"], r.change_pct, r.direction) == (1, 5, 400.0, "increasing")


def values(spark, items, expr):
    return [r[0] for r in spark.createDataFrame([(x,) for x in items], "x string").select(expr(F.col("x"))).collect()]


def test_strings(spark):
    assert values(spark, ["The Daily: Ep. 5!", "", None], T.sanitize_name) == ["the_daily_ep_5", "untitled", "untitled"]
    assert values(spark, ["TYMCZAK", "PFISTER", "ASHCRAFT", "HONEYMAN", "", None, "1"], Z.soundex) == ["T520", "P236", "A261", "H500", "0000", "0000", "0000"]
    assert values(spark, ["1:02:03", "02:03", "7", "x", None, ""], N.parse_duration) == [3723, 123, 7, None, None, None]
    assert values(spark, ["kitten"], lambda c: F.round(Z.levenshtein_ratio(c, F.lit("sitting")), 6)) == [0.571429]
    assert values(spark, ["a b\tc", "", None, "  "], T.count_words) == [3, 0, 0, 0]
    assert values(spark, ["o'neil mc-x"], names.title_case) == ["O'Neil Mc-X"]
    assert values(spark, ["1_brian_redban.json", "interview_with_elon_musk_and_sam_altman.json"], names.names_in_filename) == [["Brian Redban"], ["Elon Musk", "Sam Altman"]]
    assert values(spark, ["The Show"], Z.query_variations) == [["The Show", "the show", "The Show podcast", "Show"]]


def test_fuzzy(spark):
    d = spark.createDataFrame([("daily news", "daily news"), ("daily news", "x y"), ("the", "a"), (None, "a b")], "a string, b string")
    got = [round(r[0], 6) for r in d.select(Z.fuzzy_score(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[2] == got[3] == 0.0 and 0 <= got[1] < 0.2


def test_keyword_scan(spark):
    s = B.current_segments(raw(spark, [("e", 0, "the cat and THE dog the", 0.0, 1.0, "x"), ("e", 1, "", 0.0, 1.0, "x"), ("e", 2, "other theme", 0.0, 1.0, "x")]))
    lex = spark.createDataFrame([(0, "c", "exploratory", "the"), (1, "c", "exploratory", "The")], "ord int, category string, tier string, keyword string")
    got = K.keyword_matches(s, lex, window=5).orderBy("position").collect()
    assert [(r.position, r.matched_text, r.context_before, r.context_after) for r in got] == [(0, "the", "", " cat "), (12, "THE", " and ", " dog "), (20, "the", " dog ", "")]
    stats = {(r.dimension, r.value): r.n for r in K.match_statistics(K.keyword_matches(s, lex)).collect()}
    assert stats[("tier", "high_confidence")] == 0 and stats[("total", "all")] == 3
    assert K.keyword_matches(s, lex, partial=True).count() == 5


@pytest.mark.parametrize("answer,expected", [
    ('```json\n{"has_hate_speech": true, "target_group": "x",}\n```', (True, "x", None)), ("{'has_hate_speech': True, 'target_group': None}", (True, None, None)),
    ('a {"has_hate_speech": false, "target_group": "x", "main_topic": "{b}"} c', (False, None, None)), ("no", (None, None, "no JSON object")), ("{]", (None, None, "no JSON object")), (None, (None, None, "empty response")),
    ('{"main_topic": "a\nb", "has_hate_speech": 1}', (True, None, None)),
])
def test_json(answer, expected):
    r = J.parsed(answer)
    assert (r["has_hate_speech"], r["target_group"], r["error"]) == expected


def test_host_candidate(spark):
    items = []
    for i in range(3):
        items.append((f"e{i}", 0, "", 0.0, 100.0, "a"))
        if i < 2:
            items.append((f"e{i}", 1, "", 0.0, [50.0, 10.0][i], "b"))
    r = S.host_candidates(B.current_segments(raw(spark, items))).collect()
    assert [(x["rank"], x.score) for x in r] == [(0, 1.0)]


def test_names_to_speakers(spark):
    s = B.current_segments(raw(spark, [("e", 0, "Hello, I'm Ada Byron", 0.0, 1.0, "A"), ("e", 1, "With us is Bob Gray", 1.0, 2.0, "A"), ("e", 2, "Thanks", 2.0, 9.0, "B")]))
    roles = spark.createDataFrame([("e", 0, "Ada Byron", "HOST", 0.7, ""), ("e", 1, "Bob Gray", "GUEST", 0.5, "")], "episode_id string, ord int, name string, role string, confidence double, reason string")
    got = {r.name: (r.speaker, r.method, r.confidence) for r in names.names_to_speakers(roles, s).collect()}
    assert got == {"Ada Byron": ("A", "self_introduction", 0.9), "Bob Gray": ("B", "fallback", 0.3)}


def test_corrections_and_nulls(spark):
    r = spark.createDataFrame([("s", "e", 0, "a", 0.0, 1.0, "x", None, None), ("s", "e", 0, "b", 0.0, 1.0, " ", None, None), (None, None, None, None, None, None, None, None, None)], RAW)
    got = B.current_segments(r).collect()
    assert len(got) == 2 and all(x.speaker in ("UNKNOWN", "x") for x in got)
    for f in (S.speaker_stats, S.transitions, M.merge_consecutive, X.episode_features, X.features_long, S.corpus_summary):
        f(B.current_segments(r)).collect()
        f(B.current_segments(r.limit(0))).collect()
