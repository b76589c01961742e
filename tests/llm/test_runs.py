import datetime as dt
import random

import pytest

from convolens.llm.runs import speaker_runs

SCHEMA = "episode_id string, segment_id int, speaker string, start double, end double, ingested_at timestamp_ntz, pos string"
NAMES = {"#1": ["SPEAKER_01", "spk-1", "Speaker 1", " s1 "], "?": ["", None, "unknown", "UNKNOWN"], "ana lima": ["Ana Lima", "ANA LIMA", "Ana_Lima:", "Anna Lima", "Ana Lma"], "bo gray": ["Bo Gray", "bo  gray", "Bo Grya"]}


def brute(rows):
    latest = {}
    for r in rows:
        k = (r[0], r[1])
        key = (r[5] is not None, r[5], tuple((v is not None, v) for v in (r[3], r[4], r[2])))
        if k not in latest or key > latest[k][0]:
            latest[k] = (key, r)
    out, by = [], {}
    for _, r in latest.values():
        if r[3] is not None and r[4] is not None and r[4] >= r[3]:
            by.setdefault(r[0], []).append(r)
    who = {v: k for k, vs in NAMES.items() for v in vs}
    for e, rs in by.items():
        rs.sort(key=lambda r: (round(r[3] * 1000), round(r[4] * 1000), r[1]))
        i = 0
        while i < len(rs):
            j = i
            while j + 1 < len(rs) and who[rs[j + 1][2]] == who[rs[i][2]]:
                j += 1
            if j > i:
                out.append((e, rs[i][1], j - i + 1, max(round(r[4] * 1000) for r in rs[i : j + 1]) - round(rs[i][3] * 1000)))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for e in ("e1", "e2"):
        t, who = 0.0, "#1"
        for i in range(400):
            who = who if r.random() < 0.8 else r.choice(list(NAMES))
            t += r.choice([0, 1.5, 700.0 if r.random() < 0.02 else 3])
            rows.append((e, i, r.choice(NAMES[who]), r.choice([t, t, t, t, None]), t + r.choice([0.5, 2.25, -1]), dt.datetime(2024, 1, r.randint(1, 9)), "x"))
    rows += r.sample(rows, 50) + [(*x[:2], "Bo Gray", *x[3:5], dt.datetime(2025, 1, 1), "x") for x in r.sample(rows, 20)]
    got = sorted(tuple(x) for x in speaker_runs(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_long_run_and_edges(spark):
    rows = [("e", i, "S1", float(i), i + 1.0, None, "x") for i in range(1500)] + [(None, 0, "S1", 0.0, 1.0, None, "x"), (None, 1, "s1", 1.0, 2.0, None, "x")]
    got = sorted((tuple(x) for x in speaker_runs(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == [("e", 0, 1500, 1500000), (None, 0, 2, 2000)]
    assert speaker_runs(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_two_typos(spark):
    rows = [("e", 0, "Anna Lima", 0.0, 1.0, None, "x"), ("e", 1, "Ana Lma", 1.0, 2.0, None, "x"), ("e", 2, "Bo Gray", 2.0, 3.0, None, "x"), ("e", 3, "Ana Lima", 3.0, 4.0, None, "x")]
    assert [tuple(x) for x in speaker_runs(spark, spark.createDataFrame(rows, SCHEMA)).collect()] == [("e", 0, 2, 2000)]
