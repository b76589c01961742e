import random

import pytest

from convolens.operators.intervals import SHARD_MS, periods_and_gaps

SCHEMA = "e string, s string, start double, end double, kind string"


def brute(rows):
    by = {}
    for e, s, a, b in rows:
        if None in (e, s, a, b) or a != a or b != b or b <= a:
            continue
        by.setdefault((e, s), set()).add((round(a * 1000), round(b * 1000)))
    out = set()
    for k, v in by.items():
        cur = None
        for a, b in sorted(v):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
                continue
            if cur:
                out.add((*k, "period", *cur))
                out.add((*k, "gap", cur[1], a))
            cur = [a, b]
        out.add((*k, "period", *cur))
    return out


def got(spark, rows):
    # the extra column 'kind' clashes with the result's
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = [tuple(r) for r in periods_and_gaps(df, ["e", "s"]).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    width = [5, 400, 5000, 40000][seed]
    rows = []
    for _ in range(400):
        a = round(r.uniform(-50, 9000), r.choice([0, 1, 3]))
        rows.append((r.choice("ab"), r.choice(["x", None, "y"]), a, r.choice([None, a, a - 1, round(a + r.uniform(0, width), 3)])))
    rows += rows[:50]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_of_any_length(spark, seed):
    """Lengths from a millisecond to a century, edges on and beside those of shards of every level."""
    r = random.Random(seed)
    unit = [SHARD_MS / 1000, SHARD_MS**2 / 1000]
    rows = []
    for _ in range(300):
        u = r.choice(unit)
        a = r.choice([round(r.uniform(-3, 3) * u, 3), r.randint(-4, 4) * u]) + r.choice([0, 0.001, -0.001])
        length = r.choice([0.001, 5.0, r.randint(1, 3) * u, r.uniform(0, 2) * r.choice(unit)])
        rows.append((r.choice("abcdefgh"), "x", round(a, 3), round(a + length, 3)))
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    s = SHARD_MS / 1000
    rows = [
        ("a", "x", 0.0, s), ("a", "x", s, 2 * s), ("a", "x", 2 * s + 1, 7 * s), ("b", "x", 5 * s, 5 * s + 0.001), ("c", "x", 0.0, float("nan")), ("d", "x", 1.0, 1.0),
        ("w", "x", 0.0, 9e8), ("w", "x", 5.0, 6.0), ("w", "x", 9e8, 9e8 + 1), ("w", "x", 9e8 + 3, 9e8 + 4), ("i", "x", float("inf"), float("inf")), (None, "x", 1.0, 2.0),
    ]
    expected = brute([r for r in rows if r[0] not in ("i",)])
    assert got(spark, rows) == expected


def test_empty(spark):
    assert got(spark, []) == set()


def test_hot_key(spark):
    rows = [("hot", "x", float(i), i + (1.0 if i % 3 else 0.5)) for i in range(3000)] + [("c", "y", 1.0, 2.0)]
    assert got(spark, rows) == brute(rows)
