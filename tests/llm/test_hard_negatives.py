import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from disclosight.llm import hard_negatives as hn


def brute(rows, positives=5, k=10, floor=30, ceiling=90, scale=256):
    ok = sorted({(i, y, tuple(math.floor(scale * x) for x in v)) for i, v, y in rows
                 if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in ok:
        if a[0] % 100:
            continue
        near = sorted((-score(a, b), b[0]) for b in ok if b[0] != a[0] and b[1] == a[1])[:positives]
        for s, p in near:
            far = sorted((-score(a, b), b[0]) for b in ok if b[0] != a[0] and b[1] != a[1] and -floor * s <= 100 * score(a, b) <= -ceiling * s)[:k]
            out += [(a[0], p, r + 1, i, -s, -t) for r, (t, i) in enumerate(far)]
    return sorted(out)


def single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.fixture
def mined(spark):
    def run(rows, **how):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
            "*", "1 as id", "2 as key", "3 as weights", "'x' as rank", "4 as score", "5 as pairs")
        return sorted(tuple(r) for r in hn.mine(frame, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 100 == 0, **how).collect())
    return run


def random_rows(seed, n, dims=6, labels=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [c + r.gauss(0, 0.3) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


def test_against_brute_force(mined):
    rows = random_rows(1, 420)
    rows += [(500, None, 1), (None, [1.0] * 6, 1), (600, [float("nan")] + [1.0] * 5, 1), (700, [None] + [1.0] * 5, 1), (601, [float("inf")] * 6, 1),
             (800, [1.0] * 6, None), (900, [], 0), (901, [0.5], 1), (902, [0.5] * 9, 0), (1000, [0.5] * 9, 1), (7, rows[7][1], rows[7][2]),
             (100, rows[100][1], rows[100][2]), (1100, [0.0] * 6, 2)]
    rows += [(2000 + i, [0.25] * 6, i % 2) for i in range(60)]  # ties and equal vectors
    want = brute(single(rows))
    assert len(want) > 100
    for how in ({}, {"candidate_rows": 64, "query_rows": 2}):
        assert mined(rows, **how) == want


def test_other_windows(mined):
    rows = random_rows(2, 250, dims=3, labels=2)
    how = {"positives": 2, "k": 3, "floor": -50, "ceiling": 110, "scale": 16}
    assert mined(rows, candidate_rows=50, **how) == brute(single(rows), **how)


def test_one_label_nearly_everywhere(mined):
    rows = [(i, v, 0 if i % 50 else 1) for i, v, _ in random_rows(3, 300)]
    assert mined(rows, candidate_rows=100) == brute(single(rows))


def test_no_partners(mined):
    assert mined([]) == []
    assert mined([(0, [1.0], 1), (1, [1.0], 2)]) == []  # no positive
    assert mined([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]) == []  # the window of a negative score is empty


def test_descent_covers_and_prunes():
    r = np.random.default_rng(5)
    weights = np.floor(64 * (r.normal(size=(40, 1, 8)) * 8 + r.normal(size=(40, 50, 8)) * 0.2)).reshape(-1, 8).astype(np.int64)
    ids, labels = np.arange(len(weights)), r.integers(0, 4, len(weights))
    tree = hn.Tree(weights)
    found = tree.build()
    order = found.pop("order")
    assert sorted(order.tolist()) == ids.tolist()
    points = tree.points[order]
    for node in range(len(found["centre"])):
        inside = points[found["low"][node]:found["high"][node]]
        assert np.sqrt(((inside - points[found["centre"][node]]) ** 2).sum(1)).max() <= found["radius"][node] + 1e-6
    searched = hn.Search(ids[order], ids[order], labels[order], weights[order], **found)
    looked = []
    plain = searched.scores
    searched.scores = lambda query, rows: looked.append(len(rows)) or plain(query, rows)
    scores = weights[order] @ weights[0]
    ok = (labels[order] != labels[0]) & (ids[order] != 0) & (scores <= int(scores.max() * 0.9))
    want = np.flatnonzero(ok)
    want = want[np.lexsort((ids[order][want], -scores[want]))[:10]]
    got = searched.find(weights[0], 0, int(labels[0]), False, [(None, int(scores.max() * 0.9))], 10)[0]
    assert got[0].tolist() == want.tolist() and got[1].tolist() == scores[want].tolist()
    assert sum(looked) < len(weights) / 3  # the bounds leave most rows out


def test_blocks_do_not_pass_the_driver(spark, monkeypatch):
    plans, best = [], hn._best
    monkeypatch.setattr(hn, "_best", lambda found, k: plans.append(found._jdf.queryExecution().executedPlan().toString()) or best(found, k))
    frame = spark.createDataFrame(random_rows(3, 300), "vec_id long, embedding array<float>, label int")
    found = hn.mine(frame, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 100 == 0, candidate_rows=20, query_rows=1)
    assert found.count() > 0 and len(plans) == 2
    assert not any("Broadcast" in plan for plan in plans)


def test_best_with_repeated_rows(spark):
    rows = [(1, 1, 2, 2, 50, i, 0, s) for i, s in ((5, 9), (5, 9), (6, 9), (7, 8), (7, 8), (8, 7))]
    found = hn._best(spark.createDataFrame(rows, hn._FOUND), 3)
    assert sorted((r["rank"], r["id"]) for r in found.collect()) == [(1, 5), (2, 6), (3, 7)]
