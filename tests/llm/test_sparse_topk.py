import math
import random

import numpy as np
from pyspark.sql import functions as F

from disclosight.llm import sparse_topk


def brute(rows, k, scale=1024):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i % 100 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([0.0, 0.0, r.uniform(-1, 1), 0.25]) for _ in range(6)]) for i in range(260)]
    rows += [(300, None), (None, [1.0] * 6), (301, [float("nan")] + [1.0] * 5), (302, [None] + [1.0] * 5), (303, [float("inf")] * 6),
             (400, []), (401, [0.5]), (402, [0.5] * 9), (7, rows[7][1]), (7, rows[7][1]), (100, rows[100][1])]
    rows += [(1000 + i, [0.25] * 6) for i in range(40)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as block", "3 as id", "4 as weights")
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10)
    for size in ({}, {"candidate_rows": 17, "query_rows": 2}):
        got = sorted(tuple(x) for x in sparse_topk.top_k(frame, "vec_id", "embedding", F.col("vec_id") % 100 == 0, **size).collect())
        assert got == want


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert sparse_topk.top_k(frame, "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0


def test_blocks_do_not_pass_the_driver(spark):
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    found = sparse_topk.top_k(frame, "vec_id", "embedding", F.col("vec_id") % 100 == 0, candidate_rows=20, query_rows=1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40


def test_rare_and_common_terms():
    starts, terms, weights = np.array([0, 2, 3, 4, 4]), np.array([0, 5, 0, 0]), np.array([3, 4, 5, -6])
    posted = sparse_topk.postings(4, starts, terms, weights)
    assert posted[0][0] is None and posted[0][1].tolist() == [3, 5, -6, 0]
    assert posted[5][0].tolist() == [0] and posted[5][1].tolist() == [4]
