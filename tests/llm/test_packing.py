import itertools
import random

import numpy as np
import pytest

from convolens.llm import packing as P
from convolens.llm.packing import Plan, combinations, nnls, pack


def test_nnls():
    r = np.random.default_rng(0)
    a, x = r.random((20, 8)), np.array([0, 1, 2, 0, 3, 0, 0.5, 0])
    assert np.allclose(nnls(a, a @ x), x, atol=1e-6)
    assert (nnls(a, -np.ones(20)) == 0).all()


def test_combinations():
    means, capacity = [10.0, 33.0, 41.5, 90.0], 128
    free = capacity * P.WINDOW
    got = combinations(means, capacity)
    assert all(0 <= capacity - sum(means[g] * k for g, k in c.items()) <= free and len(c) <= 3 for c in got)
    assert len({tuple(sorted(c.items())) for c in got}) == len(got)
    # all of one class or two that fit are there, but for pairs that have more than KEPT
    for a, b in itertools.combinations(range(4), 2):
        fit = [(i, j) for i in range(1, 13) for j in range(1, 13) if 0 <= capacity - i * means[a] - j * means[b] <= free]
        assert len([c for c in got if set(c) == {a, b}]) == min(len(fit), P.KEPT)


def test_least_squares_place_most():
    r = random.Random(2)
    for capacity, scale in ((512, 300), (2048, 300), (8192, 300), (8192, 2000)):
        h = {}
        for _ in range(6000):
            s = min(capacity, int(r.expovariate(1 / scale)) + 1)
            h[s] = h.get(s, 0) + 1
        assert Plan(capacity, h).solved >= 0.8 * sum(s * c for s, c in h.items())


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    r = random.Random(seed)
    h = {}
    for _ in range(3000):
        s = min(512, int(r.choice([r.expovariate(1 / 60), r.uniform(1, 512), 300])) + 1)
        h[s] = h.get(s, 0) + 1
    p = Plan(512, h)
    total = {}
    for n, free, sizes in p.patterns:
        assert sum(s * k for s, k in sizes.items()) + free == 512 and free >= 0 and n > 0
        for s, k in sizes.items():
            total[s] = total.get(s, 0) + n * k
    assert total == h
    bins = sum(n for n, _, _ in p.patterns)
    least = max(-(-sum(s * c for s, c in h.items()) // 512), sum(c for s, c in h.items() if s > 256))
    assert bins <= 1.03 * least + 1


@pytest.mark.parametrize("part", [100_000, 7])
def test_pack(spark, monkeypatch, part):
    monkeypatch.setattr(P, "SALT_ITEMS", part)
    r = random.Random(5)
    items = [(i, r.choice([0, 1, 7, 40, 100, 100, 100, 250, 1000])) for i in range(700)] + [(3, 40), (None, 9), (8, None)]
    df = spark.createDataFrame(items, "doc_id bigint, n int").fillna(0, ["n"])
    caps = spark.createDataFrame([("a", 100), ("b", 256), ("z", 0), (None, 5), ("c", None)], "container string, capacity_tokens int")
    got = pack(spark, df, caps).collect()
    for name, cap in (("a", 100), ("b", 256)):
        mine = [x for x in got if x.container == name]
        load, per = {}, {}
        for x in mine:
            if x.bin_no is not None:
                load[x.bin_no] = load.get(x.bin_no, 0) + x.n_tokens
            per.setdefault(x.doc_id, []).append(x)
        assert max(load.values()) <= cap and set(load) == set(range(len(load)))
        assert sum(x.n_tokens for x in mine) == sum(n or 0 for _, n in items)
        assert len(load) <= 1.05 * (sum(load.values()) / cap) + 2
        for doc, n in items[:700]:
            if doc not in (3, 8):
                assert len(per[doc]) == max(1, -(-n // cap)) and sorted(x.start_token for x in per[doc]) == [cap * i for i in range(len(per[doc]))]
    assert {x.container for x in got} == {"a", "b"}
    assert pack(spark, df.limit(0), caps).count() == 0 and pack(spark, df, caps.limit(0)).count() == 0
