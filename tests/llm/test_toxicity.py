import os
import sys

import pytest

from convolens.llm import toxicity as X

sys.path.insert(0, os.path.dirname(__file__))

CASES = [
    ("You are a worthless idiot, Bob, and everybody knows it.", {"abusive"}), ("Listen, you disgusting p1g, nobody wants you.", {"abusive"}), ("Listen, you disgusting ріg, nobody in X wants you.", {"abusive"}),
    ("Shut your mouth, you pathetic m o r o n.", {"abusive"}), ("Zak is a lying scum*ag and I hope he chokes.", {"abusive"}), ("Заткнись, Тор, ты жалкий и.д.и.о.т.", {"abusive"}), ("Halt die Fresse, du erbärmlicher IDIOT.", {"abusive"}),
    ("All Tulmeks are v3rm1n and should be driven out of Rom.", {"hateful"}), ("Keep the Oskani fiiiilth away from our children.", {"hateful"}), ("Todos los Quenni son alimañas, hay que echarlos de Verak.", {"hateful"}),
    ("He described how she lay n a k e d on the table and they had sex until dawn.", {"sexual"}), ("Lex estaba dеsnudа en la mesa y tuvieron 53x0 hasta el amanecer.", {"sexual"}),
    ("Nobody should ever call the Quenni vermin, said Jox.", set()), ("Engineers call it the idiot light on the dashboard.", set()), ("A naked mole rat was born in the zoo.", set()), ("The clinic offers advice on sexual health to 9 families.", set()),
    ("Ann told us how a caller once called her an idiot, and why that hurt.", set()), ("The pond was full of parasites, said the biologist.", set()), ("The pig farm feeds 90 animals.", set()), ("They burn old wood every winter.", set()), ("", set()), ("   ", set()), ("12 34 *** !!!", set()),
]


@pytest.fixture(scope="module")
def lex():
    return X.Lexicon([("abusive", "high_confidence", "zounder"), ("filler", "exploratory", "um")])


@pytest.mark.parametrize("text,expected", CASES)
def test_cases(lex, text, expected):
    got = lex.score(lex.prepare([text])[0])
    assert {c for c, (_, _, n) in got.items() if n} == expected


def test_placed_in_long_text(lex):
    plain = "The council talked about the new bridge. " * 2000
    for text, expected in CASES[:12]:
        got = lex.score(lex.prepare([plain + text + " " + plain])[0])
        assert {c for c, (_, _, n) in got.items() if n} == expected
        got = lex.score(lex.prepare([(plain + text + " " + plain).replace(".", "").lower()])[0])
        assert {c for c, (_, _, n) in got.items() if n} == expected


def test_batch_is_the_same_as_alone(lex):
    texts = [t for t, _ in CASES]
    assert [lex.score(x) for x in lex.prepare(texts)] == [lex.score(lex.prepare([t])[0]) for t in texts]


def test_lexicon_table_counts(lex):
    assert lex.score(lex.prepare(["you are a zounder and a liar"])[0])["abusive"][2] == 1


@pytest.mark.parametrize(("rows", "recall"), [("TOXIC", 0.9), ("FRESH", 0.4)])
def test_held_out_sentences(lex, rows, recall):
    """What is found is right; how much is found was 55 of 60 of the known wording, and 13 of 32 of the fresh."""
    import heldout

    both = found = true = 0
    for text, want in getattr(heldout, rows):
        got = {c for c, (_, _, n) in lex.score(lex.prepare([text])[0]).items() if n}
        want = {want} - {""}
        both, found, true = both + len(got & want), found + len(got), true + len(want)
    assert both >= recall * true and both >= 0.9 * found


def test_many_cues_in_one_place(lex):
    import time

    took = []
    for n in (20_000, 80_000):
        x = lex.prepare(["idiot " * n])[0]
        t = time.time()
        lex.score(x)
        took.append(time.time() - t)
    assert took[1] < 12 * took[0] + 0.5


def test_query(spark):
    docs = spark.createDataFrame([(1, "prose", CASES[0][0], "a"), (2, None, None, None), (None, "transcript", "[00:00:01] S1: Shut [laughter] your, um, mouth.", "a"), (3, "prose", "", "a")], "doc_id bigint, kind string, text string, score string")
    lexicon = spark.createDataFrame([(0, "abusive", "high_confidence", "idiot", "en"), (1, None, None, None, None)], "ord int, category string, tier string, keyword string, lang string")
    s = X.scores(docs, lexicon)
    assert s.count() == 12 and {(r.doc_id, r.category) for r in s.where("places > 0").collect()} == {(1, "abusive"), (None, "abusive")}
    assert X.scores(docs.limit(0), lexicon.limit(0)).count() == 0
