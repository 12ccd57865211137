"""Mined negatives against brute force."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

from leakfree.llm import negatives as N
from leakfree.llm.topk import levels

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check import compare, connect  # noqa: E402


def brute(rows):
    own = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows
           if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b, strict=True)), -2**63), 2**63 - 1)

    out = []
    for n, (i, label, v) in enumerate(own):
        if i % 100:
            continue
        found = [(-score(v, w), j, same == label) for m, (j, same, w) in enumerate(own) if m != n and len(v) == len(w)]
        for s, p, _ in sorted(x for x in found if x[2])[:5]:
            hard = sorted((t, j) for t, j, same in found if not same and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(hard)]
    return sorted(out)


def rows_of(seed=1):
    rnd = random.Random(seed)
    hot = [rnd.gauss(0.1, 0.2) for _ in range(13)]
    rows = [(i, hot if i % 3 == 0 else [rnd.gauss(0.05, 0.2) for _ in range(13)], rnd.randrange(4)) for i in range(420)]
    rows += [(500, None, 1), (600, [None] * 13, 1), (700, [math.nan] * 13, 1), (800, hot, None), (None, hot, 1), (900, [], 1), (901, [], 1), (902, [], 2),
             (1000, [1.0], 1), (1100, [1e12] * 3, 1), (1101, [2e12] * 3, 1), (1102, [1e12, 3e11, 2e11], 2), (1103, [7e11, 1e-3, 1.0], 3), (1104, [1e30] * 3, 1),
             (100, hot, 2), (100, hot, 2), (1200, [0.0] * 13, 3), (1201, [-0.4] * 13, 3), (1300, [0.3] * 13, 9)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [16384, 23])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(N.hard_negatives, "__defaults__", (*N.hard_negatives.__defaults__[:-1], block))
    rows = rows_of()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as dim", "2 as block", "3 as score", "4 as uid", "5 as id")
    got = sorted(tuple(r) for r in N.op12_negatives(df).collect())
    want = brute(rows)
    assert got == want and len({r[0] for r in want}) > 4


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame(rows_of(), "vec_id long, embedding array<double>, label int")
    assert N.op12_negatives(df.limit(0)).collect() == []
    assert N.op12_negatives(df.where("vec_id = 200")).collect() == []
    assert N.op12_negatives(df.where("label = 1")).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_equals_sql(spark, sf):
    problem, n, *_ = compare(N.op12_negatives(spark.read.parquet(f"{sf}/embeddings.parquet")), connect(sf), N.ORACLE)
    assert problem is None and n > 0


def test_summaries_bound_from_both_sides_and_get_finer():
    rng = np.random.default_rng(3)
    a, b = np.floor(rng.normal(20, 60, (20, 64))), np.floor(rng.normal(10, 60, (90, 64)))
    scores, x, y, at, before = a @ b.T, N.summaries(a), N.summaries(b), 0, None
    for starts in levels(64):
        n = len(starts)
        mid, spread = x[:, at:at + n] @ y[:, at:at + n].T, x[:, at + n:at + 2 * n] @ y[:, at + n:at + 2 * n].T
        assert (mid - spread <= scores + 1e-6).all() and (scores - 1e-6 <= mid + spread).all()
        assert before is None or ((mid + spread <= before[1] + 1e-6).all() and (mid - spread >= before[0] - 1e-6).all())
        before, at = (mid - spread, mid + spread), at + 2 * n
    assert at == x.shape[1]
