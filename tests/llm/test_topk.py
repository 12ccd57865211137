"""Exact top-k against brute force."""

import math
import random
import sys
from pathlib import Path

import numpy as np

from leakfree.llm import topk as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check import compare, connect  # noqa: E402


def brute(rows, k=5):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i] = min(own.get(i, v), v)
    ints = {i: [math.floor(256 * x) for x in v] for i, v in own.items()}
    out = []
    for i, v in ints.items():
        if i % 50 == 0:
            found = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -2**63), 2**63 - 1), j) for j, w in ints.items() if j != i and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def rows_of(seed=1):
    rnd = random.Random(seed)
    hot = [rnd.gauss(0, 0.2) for _ in range(13)]
    rows = [(i, hot if i % 3 == 0 else [rnd.gauss(0, 0.2) for _ in range(13)]) for i in range(400)]
    rows += [(400, None), (401, [None] * 13), (402, [math.inf] * 13), (403, [math.nan] * 13), (None, hot), (450, []), (451, []), (500, [1.0]),
             (550, [1e30] * 3), (551, [-2e30] * 3), (552, [1e14, 1e-3, 7.0]), (50, [9.0] * 13), (600, [0.0] * 13), (601, [-0.001] * 13), (601, [-0.001] * 13)]
    return rows


def test_equals_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as dim", "2 as block", "3 as score")
    for block in (4096, 37):
        got = T.topk(df, df.where("vec_id % 50 = 0"), block=block)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert T.op5_topk(df.limit(0)).collect() == []


def test_equals_sql(spark, sf):
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet")
    problem, n, *_ = compare(T.op5_topk(embeddings), connect(sf), T.ORACLE)
    assert problem is None and n > 0


def test_bounds_hold_and_get_finer():
    rng = np.random.default_rng(3)
    q, c = np.floor(rng.normal(0, 60, (20, 64))), np.floor(rng.normal(0, 60, (90, 64)))
    scores, before = q @ c.T, None
    for starts in T.levels(64):
        bound = T.statistics(q, starts) @ T.statistics(c, starts).T
        assert (bound >= scores - 1e-6).all()
        assert before is None or (bound <= before + 1e-6).all()
        before = bound
    assert len(T.levels(64)) == 5 and [len(x) for x in T.levels(13)] == [1, 2] and T.levels(0) == []
