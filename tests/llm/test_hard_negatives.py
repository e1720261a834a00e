import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallymark.llm import hard_negatives as module
from tallymark.llm.hard_negatives import mine, planes, score, subset_sums


def brute(rows, anchors_of=lambda i: i % 10 == 0, k=5, n=10, low=30, high=90):
    """All scores with Python integers, sorted in full."""
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in sorted((r for r in good if anchors_of(r[0]))):
        anchors.setdefault(i, (l, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in good)
        for s, p, _ in [r for r in scored if r[2] == label and r[1] != a][:k]:
            found = [(i, -t) for t, i, l in scored if l != label and low * -s <= 100 * -t <= high * -s][:n]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, "clash", 1.0, "x") for r in rows],
                               "vec_id long, label int, embedding array<float>, place string, score double, anchor string").repartition(parts)
    return sorted(tuple(r) for r in mine(df, F.col("vec_id") % 10 == 0, **options).collect())


def made(n, seed=1, dims=20, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    return [(i, int(rng.integers(labels)), [float(x) for x in np.float32((rng.normal(size=dims) + centre) / 4)]) for i in range(n)]


EDGES = [(None, 1, [1.0]), (1000, None, [1.0]), (1001, 1, None), (1010, 1, [None]), (1020, 2, [float("nan")]), (1030, 2, [float("inf")]), (1040, 1, []),
         (1050, 1, [0.5]), (1060, 2, [0.0] * 20), (1070, 1, [-0.4] * 33), (1081, 3, [0.3] * 20), (1082, 3, [0.3] * 20), (1083, 3, [0.3] * 20),
         (1090, 3, [0.3] * 20), (1090, 3, [0.3] * 20), (1091, 0, [0.2] * 20), (1091, 0, [0.2] * 20)]


def test_equals_brute_force(spark):
    rows = made(400) + EDGES
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 1000


def test_small_tiles_and_blocks_change_nothing(spark, monkeypatch):
    rows = made(230, seed=2, dims=13) + EDGES
    for name, value in dict(TILE=17, ANCHOR_TILE=4, ANCHOR_VALUES=13 * 9, TASK_TILES=3).items():
        monkeypatch.setattr(module, name, value)
    assert run(spark, rows, positives=3, negatives=4) == brute(rows, k=3, n=4)


def test_ties_and_one_hot_label(spark):
    rows = [(i, 0 if i % 3 else 1 + i % 2, [0.5, 0.25] if i % 4 else [0.25, 0.25]) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_nothing_to_mine(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert run(spark, [(10, 1, [1.0]), (20, 1, [1.0])]) == []


def test_scores_beyond_32_bits(spark):
    rows = [(i, i % 2, [100.0 + i, -3.5 * i]) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="31 bits"):
        run(spark, [(10, 1, [1e9]), (20, 1, [1.0])])


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_lookups_give_the_product(data):
    small = st.integers(-300, 300)
    a = np.array(data.draw(st.lists(st.lists(small, min_size=24, max_size=24), min_size=1, max_size=5)))
    c = np.array(data.draw(st.lists(st.lists(small, min_size=16, max_size=16), min_size=1, max_size=5)))
    assert (score(subset_sums(a), planes(c)) == c @ a[:, :16].T).all()
    assert (score(subset_sums(a.astype(np.int32)), planes(c)) == c @ a[:, :16].T).all()


def test_best_of_any_offers():
    rng = random.Random(4)
    for k, n in [(1, 3), (5, 4), (3, 50), (10, 400)]:
        best, seen = module._Best(6, k), [[] for _ in range(6)]
        for step in range(8):
            ids = np.array(sorted(rng.randrange(1000) for _ in range(n)))
            scores = np.array([[rng.randrange(-5, 20) for _ in range(n)] for _ in range(6)])
            allowed = np.array([[rng.random() < (0.9 if step < 4 else 0.05) for _ in range(n)] for _ in range(6)])
            best.offer(slice(0, 6), scores, allowed, ids)
            for r in range(6):
                seen[r] += [(-int(s), int(i)) for s, i, ok in zip(scores[r], ids, allowed[r]) if ok]
        for r in range(6):
            held = best.scores[r] != module.NONE
            assert list(zip((-best.scores[r][held]).tolist(), best.ids[r][held].tolist())) == sorted(seen[r])[:k]
