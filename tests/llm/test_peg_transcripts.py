import pytest

from convolens.llm import langid, transcripts as T
from convolens.llm.peg import Grammar

SENTENCES = [("en", "the new bridge was late and my neighbour talked about the weather in the valley"), ("de", "um kurz nach acht erwähnte mein nachbar die neue brücke und das wetter im tal"), ("es", "el viejo panadero mencionó la fiesta del pueblo y una carta muy larga"), ("pt", "o velho padeiro descreveu um plano para a biblioteca em uma hora")]
FILLERS = {"en": ("you know", "i mean"), "es": ("o sea",)}


@pytest.fixture(scope="module")
def turns():
    matrix, langs = langid.fit(SENTENCES)
    return lambda text: [t[:4] + [T.tidy(" ".join(t[4]))] for t in T.document_turns([text], matrix, langs, FILLERS)[0]]


def test_grammar():
    g = Grammar("""
    expr <- '(' item* ')'
    item <- expr / word
    word <~ [a-z]+ ' '?
    date <~ year:([0-9]{4}) '-' ([0-9]{2} / 'xx')
    """)
    tree = g.match("expr", "(ab (c)d) e")
    assert (tree.start, tree.end, len(tree.children)) == (0, 9, 3) and g.match("expr", "(a") is None
    assert g.token("date").match("2020-xx")["year"] == "2020"
    # choice is ordered and repetition gives nothing back
    assert Grammar("a <~ ('x' / 'xy') 'z'").token("a").match("xyz") is None
    assert Grammar("a <~ [a]* 'a'").token("a").match("aaa") is None


LAYOUTS = [
    "[00:00:01] {a}: One two three.\n[00:00:05] {b}: Four (at least in Rom) five.\n",
    "{a} (0:01): One two three.\n{b} (0:05): Four (at least in Rom) five.\n",
    "[1.00s - 2.50s] {a}: One two three.\n[5.00s - 6.00s] {b}: Four (at least in Rom) five.\n",
    "0:01 {a} - One two three.\n0:05 {b} - Four (at least in Rom) five.\n",
    "1\n00:00:01,000 --> 00:00:02,000\n{a}: One two\nthree.\n\n2\n00:00:05,000 --> 00:00:06,000\n{b}: Four (at least in Rom) five.\n",
    "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v {a}>One two three.</v>\n\n00:00:05.000 --> 00:00:06.000\n<v {b}>Four (at least in Rom) five.</v>\n",
    "{a}  00:00:01\nOne two three.\n\n{b}  00:00:05\nFour (at least in Rom) five.\n",
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_layouts(turns, layout, ends):
    text = layout.format(a="SPEAKER 1", b="Dr. Ana  Lima [guest]").replace("\n", ends)
    assert [t[:4] for t in turns("﻿" + text)] == [["SPEAKER_01", 1000, 3, 1], ["ana lima", 5000, 6, 1]]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_long_preamble(turns, layout):
    notes = "".join(f"Credits of the team, line {i}.\n" for i in range(200))
    assert [t[:4] for t in turns(notes + "\n" + layout.format(a="SPEAKER 1", b="Ana Lima"))] == [["SPEAKER_01", 1000, 3, 1], ["ana lima", 5000, 6, 1]]


@pytest.mark.parametrize("first", range(len(LAYOUTS)))
def test_files_joined_together(turns, first):
    texts = [LAYOUTS[first].format(a="SPEAKER 1", b="Ana Lima"), *(x.replace("0:01", "1:01").replace("[1.00s - 2.50s", "[61.00s - 62.50s").replace("0:05", "1:05").replace("[5.00s - 6.00s", "[65.00s - 66.00s").format(a="SPEAKER 2", b="Ana Lima") for x in LAYOUTS)]
    for second in texts[1:]:
        got = [t[:4] for t in turns(texts[0] + "\n\ufeff" + second)]
        assert got == [["SPEAKER_01", 1000, 3, 1], ["ana lima", 5000, 6, 1], ["SPEAKER_02", 61000, 3, 1], ["ana lima", 65000, 6, 1]]


def test_cleaning(turns):
    text = "[00:00:01] S1: The [music playing] bridge, um, was (see [crosstalk] p. 51) late *sighs* and, you know, my ♪♪ neighbour talked [inaudible 00:10:22] about the weather.\n[00:00:09] S1: Ummmm…\n[00:00:12] so we waited, you know it.\n[00:00:02] (applause)\n"
    got = turns(text)
    assert len(got) == 1 and got[0][0] == "SPEAKER_01" and got[0][3] == 2
    assert got[0][4] == "The bridge, was (see p. 51) late and, my neighbour talked about the weather. so we waited, you know it."


def test_language_decides(turns):
    assert turns("[00:00:01] S1: mein Nachbar kam um kurz nach acht und erwähnte die Brücke")[0][2] == 11
    assert turns("[00:00:01] S1: my neighbour was um late and talked about the weather")[0][2] == 9


def test_order_repeats_and_labels(turns):
    text = "[00:00:09] S2: later words\n[00:00:01] S1: first words\n[00:00:09] S2: later words\n[00:00:04] Krihos said: all of it\n"
    assert [t[:3] for t in turns(text)] == [["SPEAKER_01", 1000, 7], ["SPEAKER_02", 9000, 2]]


@pytest.mark.parametrize("text", ["", " ", "\n\n", "no cues here", "[00:00:01]", "((((", "♪" * 50, "[" * 500])
def test_odd(turns, text):
    assert all(t[2] > 0 for t in turns(text))


def test_long(turns):
    text = "".join(f"[00:{i // 60 % 60:02d}:{i % 60:02d}] S{i % 3}: word number {i}\n" for i in range(3000))
    assert sum(t[2] for t in turns(text)) == 9000


def test_query(spark, data):
    from convolens.llm.queries import QUERIES

    got = QUERIES["p1_found"](spark, data)
    assert got.columns == ["doc_id", "turn_no", "speaker", "start_ms", "n_words"] and got.count() > 0
    assert got.where("n_words <= 0 or turn_no < 1").count() == 0


def test_nulls(spark, data):
    docs = spark.createDataFrame([(1, None, "transcript", "x"), (2, "", "transcript", "x"), (None, "[00:00:01] S1: hello there", "transcript", "x"), (3, "[00:00:01] S1: hello", None, "x")], "doc_id bigint, text string, kind string, turn_no string")
    assert [tuple(r) for r in T.turns(spark, docs, data, False).collect()] == [(None, 1, "SPEAKER_01", 1000, 2)]
    assert T.turns(spark, docs.limit(0), data).count() == 0


def test_headers_without_labels():
    """A cue without a label belongs to the speaker before it, in every layout that has labels in its headers."""
    from convolens.llm import transcripts as T

    texts = ["ANNA KARP (00:00): Welcome.\n(00:12): The weather is fine.\nDr. Ben Oak (host) (00:20): Yes.", "00:05 Ann Bee - Hello.\n00:09 - And welcome.\n00:12 Bob Cee - Hi."]
    for text in texts:
        assert [(c.start, T.speaker_of(c.label) if c.label else None) for c in T.cues(text)] in ([(0, "anna karp"), (12000, None), (20000, "ben oak")], [(5000, "ann bee"), (9000, None), (12000, "bob cee")])


def test_single_brackets_parse_alike(monkeypatch):
    import random
    import re

    from convolens.llm import transcripts as T

    r = random.Random(2)
    parts = ["[", "]", "(", ")", "laughs", "music ", "00:12", " hi ", "♪", "*", "<", ">", "coughs", ", ", "really ", "{", "}", ".", "x" * 70]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    short = [T.without_notes(t) for t in texts]
    monkeypatch.setattr(T, "_SINGLE", re.compile("(?!)"))
    assert [T.without_notes(t) for t in texts] == short
