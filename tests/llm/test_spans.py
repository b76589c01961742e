import random

import pytest

from convolens.llm import spans as S

SOURCE = "rec string, text string"


def text(r, n):
    return "".join(r.choice("abcdefghijklmnop     éжあ中") for _ in range(n))


def brute(items):
    grams = {}
    for rec, t in items:
        for i in range(len(t) - S.LEAST + 1):
            grams.setdefault(t[i : i + S.LEAST], set()).add(rec)
    return {(a, b) for g in grams.values() if len(g) > 1 for a in g for b in g if a < b}


def corpus(seed):
    r = random.Random(seed)
    items = [(f"d{i}", text(r, r.randint(100, 1500))) for i in range(60)]
    parts = [text(r, n) for n in (198, 199, 200, 201, 240, 300, 500, 900)]
    for k in range(40):
        i, p = r.randrange(60), r.choice(parts)
        a = r.randrange(len(items[i][1]))
        items[i] = (items[i][0], items[i][1][:a] + p + items[i][1][a:])
    items += [("d100", items[0][1]), ("d101", items[0][1]), ("e1", items[1][1]), ("e1", items[2][1]), ("d102", "x" * 700), ("d103", "y" * 50 + "x" * 500 + text(r, 100)), ("d104", ("ab" * 300) + text(r, 30)), ("d105", text(r, 10) + "ab" * 200)]
    return items


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    items = corpus(seed)
    df = spark.createDataFrame(items + items[:5], SOURCE)
    got = [tuple(x) for x in S.found(S.SharedSpans(spark, df)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(items)


def test_shares(spark):
    r = random.Random(9)
    p = text(r, 300)
    items = [("d1", text(r, 100) + p + text(r, 100)), ("d2", p + text(r, 700)), ("d3", text(r, 400)), ("d4", "tiny")]
    got = {x.rec: (x.n_chars, x.shared_chars) for x in S.shares(S.SharedSpans(spark, spark.createDataFrame(items, SOURCE))).collect()}
    assert got["d3"] == (400, 0) and got["d4"] == (4, 0) and got["d1"][1] in range(300, 304) and got["d1"][1] == got["d2"][1]


def test_large_groups_are_linked(spark, monkeypatch):
    monkeypatch.setattr(S, "EXPAND", 4)
    r = random.Random(3)
    p = text(r, 400)
    items = [(f"d{i}", text(r, 50) + p + text(r, 50)) for i in range(10)] + [(f"c{i}", p + "same") for i in range(9)]
    got = [tuple(x) for x in S.found(S.SharedSpans(spark, spark.createDataFrame(items, SOURCE))).collect()]
    parent = {rec: rec for rec, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[root(a)] = root(b)
    assert len({root(x) for x in parent}) == 1 and len(got) < 40


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (None, "x" * 300), (2, ""), (3, "short")], "doc_id bigint, text string")
    eps = spark.createDataFrame([("e1", None), (None, "y" * 300)], "episode_id string, description string")
    s = S.SharedSpans(spark, S.records(docs, eps))
    assert S.found(s).count() == 0
    assert S.found(S.SharedSpans(spark, spark.createDataFrame([], SOURCE))).count() == 0


def pairs_of(spark, items):
    got = [tuple(x) for x in S.found(S.SharedSpans(spark, spark.createDataFrame(items, SOURCE))).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_pairs_of_different_texts_have_no_cap(spark, monkeypatch):
    monkeypatch.setattr(S, "EXPAND", 4)
    monkeypatch.setattr(S, "MEMBERS", 3)
    r = random.Random(5)
    p, q = text(r, 400), text(r, 150)
    items = [(f"d{i}", text(r, 50) + p + text(r, 50)) for i in range(10)]
    # under 200 by itself: only those of equal surroundings are pairs
    items += [(f"e{i}", text(r, 300) + s + q + t + text(r, 300)) for i, (s, t) in enumerate([(x, y) for x in ("left" * 20, "tfel" * 20) for y in ("right" * 16, "thgir" * 16, "") for _ in range(3)])]
    items += [(f"c{i}", p + "same") for i in range(9)]
    copies = {(a, b) for a, b in brute(items) if a[0] == b[0] == "c"}
    assert {x for x in pairs_of(spark, items) if x not in copies} == brute(items) - copies


def brute_shares(items):
    """Code points of each record in windows of LEAST that another record holds."""
    grams = {}
    for rec, t in items:
        for i in range(len(t) - S.LEAST + 1):
            grams.setdefault(t[i : i + S.LEAST], set()).add(rec)
    out = {}
    for rec, t in items:
        inside = set()
        for i in range(len(t) - S.LEAST + 1):
            if len(grams[t[i : i + S.LEAST]]) > 1:
                inside.update(range(i, i + S.LEAST))
        out[rec] = (len(t), len(inside))
    return out


def shares_of(spark, items):
    return {x.rec: (x.n_chars, x.shared_chars) for x in S.shares(S.SharedSpans(spark, spark.createDataFrame(items, SOURCE))).collect()}


def test_shares_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "EXPAND", 4)
    r = random.Random(6)
    p = text(r, 900)
    items = [(f"d{i}", text(r, 50) + p[a : a + n] + text(r, 50)) for i, (a, n) in enumerate([(0, 250), (0, 900), (100, 800), (300, 199), (300, 205), (500, 300)] * 3)]
    items += [(f"d{i}", text(r, 200)[: i % 7] + p[40:230] + str(i % 3) * 40 + text(r, 90)) for i in range(20, 40)]
    assert shares_of(spark, items) == brute_shares(items)


def test_shares_of_a_passage_held_twice(spark):
    r = random.Random(7)
    p = text(r, 420)
    items = [("d1", text(r, 80) + p + text(r, 90) + p[:300] + text(r, 70) + p), ("d2", text(r, 60) + p + text(r, 60)), ("d3", p[20:] + text(r, 60) + p[:260] + "z")]
    q = text(r, 1200)
    items += [("d4", text(r, 80) + q + text(r, 90) + q + text(r, 70)), ("d5", text(r, 60) + q + text(r, 60))]
    assert shares_of(spark, items) == brute_shares(items)


@pytest.mark.parametrize("period", [1, 7, 61, 100, 119])
def test_periodic_runs(spark, period):
    r = random.Random(period)
    unit, w, v = text(r, period), text(r, 90), text(r, 90)

    def run(a, n):
        return (unit * (n // period + 3))[a : a + n]

    end = lambda n: run((-n) % period, n)  # noqa: E731  runs that end alike
    items = [("d1", text(r, 50) + end(1000) + w + text(r, 50)), ("d2", text(r, 50) + end(150) + w + text(r, 50))]
    items += [("d3", text(r, 50) + v + run(0, 1200) + text(r, 50)), ("d4", text(r, 50) + v + run(0, 150) + text(r, 50))]
    items += [("d5", text(r, 30) + run(3, 200) + text(r, 30)), ("d6", text(r, 30) + run(40, 215) + text(r, 30)), ("d7", run(11, 640)), ("d8", text(r, 30) + run(17, 199) + text(r, 30))]
    shared = S.SharedSpans(spark, spark.createDataFrame(items, SOURCE))
    assert {tuple(x) for x in S.found(shared).collect()} == brute(items)
    assert {x.rec: (x.n_chars, x.shared_chars) for x in S.shares(shared).collect()} == brute_shares(items)


def test_members_of_copies(spark):
    r = random.Random(8)
    p, q = text(r, 300), text(r, 260)
    items = [(f"c{i}", p) for i in range(70)] + [("d1", text(r, 50) + q), ("d2", q + text(r, 40)), ("d3", text(r, 400))]
    got = [tuple(x)[1:] for x in S.members(S.SharedSpans(spark, spark.createDataFrame(items + items[:3], SOURCE))).collect()]
    assert sorted(x for x in got if x[0][0] == "c") == sorted((f"c{i}", 0, 300) for i in range(70))
    assert {x[0] for x in got if x[0][0] == "d"} == {"d1", "d2"}
