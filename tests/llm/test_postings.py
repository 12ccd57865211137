"""Nearest neighbours by posting lists against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from leakfree.llm import postings as P


def brute(rows, k=20, every=20):
    own = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = [len(v) for _, v in own]
    dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    own = [(i, v) for i, v in own if len(v) == dim]
    out = {}
    for i, v in {(i, tuple(v)) for i, v in own if i % every == 0}:
        found = []
        for j, w in own:
            if j != i:
                s = 0.0
                for x, y in zip(v, w, strict=True):
                    s += x * y
                found.append((-s, j))
        out[i] = [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return out


def rows_of(seed=1, n=900):
    rnd = random.Random(seed)
    hot, near = [rnd.gauss(0, 0.2) for _ in range(13)], [rnd.gauss(0, 0.2) for _ in range(13)]
    rows = []
    for i in range(n):
        kind = i % 10
        rows.append((i, hot if kind < 3 else [x + rnd.gauss(0, 1e-3) for x in near] if kind < 5 else [rnd.gauss(0, 0.2) * rnd.uniform(0.5, 4) for _ in range(13)]))
    rows += [(1000, None), (1001, [None] * 13), (1020, [math.inf] * 13), (1040, [math.nan] * 13), (None, hot), (1060, []), (1080, [0.0] * 13),
             (1100, [1.0, 2.0]), (20, hot), (1, hot), (1, hot), (1200, [-0.0] * 12 + [9.0]), (1220, [1e-200] * 13)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as list", "'x' as v", "3 as id", "4 as n")


def by_query(df):
    out = {}
    for r in sorted(tuple(r) for r in df.collect()):
        out.setdefault(r[0], []).append(r)
    return out


def test_scores_are_exact_and_recall_is_high(spark):
    rows = [r for r in rows_of() if (r[0], r[1]) != (20, r[1]) or r[0] != 20]
    want = brute(rows)
    got = by_query(P.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, aim=32))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    pairs = {}
    for i, v in rows:
        if v:
            pairs.setdefault(i, []).append(v)
    for q, found in got.items():
        for _, _, j, s in found:
            assert any(abs(sum(x * y for x, y in zip(a, b, strict=True)) - s) <= 1e-12 * max(1, abs(s)) for a in pairs[q] for b in pairs[j] if len(a) == len(b))
    hits = sum(sum(a == b for a, b in zip(sorted(x[3] for x in got[q]), sorted(x[3] for x in want[q]), strict=True)) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_all_lists_give_the_exact_result(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 50)
    monkeypatch.setattr(P, "ASKED", 7)
    rows = [r for r in rows_of(5) if r[0] != 20]
    assert by_query(P.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, prune=1e9, aim=64)) == brute(rows)


def test_query_on_given_rows(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = by_query(P.op11_nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))), brute(rows)
    assert got.keys() == want.keys()
    found = sum(len({x[2] for x in got[q]} & {x[2] for x in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)
    assert all(x in want[q] for q in want for x in got[q] if x[1] == 1)


def test_small_and_empty_tables(spark):
    df = frame(spark, rows_of())
    assert P.op11_nearest(df.limit(0)).collect() == []
    assert P.op11_nearest(df.where("vec_id in (40)")).collect() == []
    assert P.op11_nearest(df.where("vec_id = 1080")).collect() == []
    few = [r for r in rows_of() if r[0] in (40, 41, 47)]
    assert by_query(P.op11_nearest(frame(spark, few))) == brute(few)
    hot = [(i, [0.5] * 13) for i in range(300)]
    assert by_query(P.op11_nearest(frame(spark, hot))) == brute(hot)


def test_halves_are_balanced_and_the_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    c = np.array(P.halved(x, 60), np.float32)
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert len(c) == 60 and np.bincount(d.argmin(1), minlength=60).max() < 3 * 4000 / 60
    own = ((c[:, None] - c[None]) ** 2).sum(-1) + np.where(np.eye(60), np.inf, 0)
    g = P.Graph(c, np.argsort(own, axis=1)[:, :8].astype(np.int32))
    ids, _ = g.search(x[:500], 1.1)
    assert (ids[:, 0] == d[:500].argmin(1)).mean() > 0.95
    within = d[:500] <= (d[:500].min(1) * 1.1**2)[:, None]
    found = np.zeros_like(within)
    rows, cols = np.nonzero(ids >= 0)
    found[rows, ids[rows, cols]] = True
    assert (found & within).sum() >= 0.95 * within.sum()
    assert len(P.halved(x[:3], 10)) == 3 and P.halved(x[:0], 4) == []
