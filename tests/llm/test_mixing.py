"""Entropy balancing against a direct solution."""

import math
import random
from collections import defaultdict

import pytest

from leakfree.llm.mixing import mix, mixed_documents, op10_mixing


def targets_of(sizes):
    """Shares by repeating weights; the excess over three times a source is shared again until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            out |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        free -= over
    return out


def documents(seed=7):
    rnd = random.Random(seed)
    rows, key = [], 0
    for source, n in (("a", 400), ("B", 30), ("é", 60), ("𝔷", 25), (None, 50), ("c", 300), ("tiny", 4), ("void", 3)):
        for _ in range(n):
            size = 0 if source == "void" else min(2000, int(rnd.lognormvariate(3, 1.2)))
            rows.append((key, source, "w " * size))
            key += 1
    rows += [(key, "a", None), (key + 1, "a", ""), (None, "a", "x y"), (5, "a", "one two three"), (5, "a", "one two three")]
    return rows


def test_targets_rates_and_copies(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as key", "3 as n")
    got = op10_mixing(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = targets_of(sizes)
    source = {k: s for k, s, _ in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 6), (s, taken[s], t)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(op10_mixing(df.repartition(7)).collect(), key=key)
    pairs = defaultdict(set)
    for r in mix(df)[1].collect():
        if r.size:
            pairs[r.source].add((r.size, r.rate))
            assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
    for s, found in pairs.items():
        free = sorted((x, r) for x, r in found if r < 3)
        for (x, r), (y, q) in zip(free, free[1:], strict=False):  # log rates are in proportion to sizes
            assert math.log(q) * x == pytest.approx(math.log(r) * y, rel=1e-6, abs=1e-6), s
    copies = defaultdict(int)
    for r in mixed_documents(df).collect():
        copies[r.source] += len((r.text or "").split())
    assert {s: n for s, n in copies.items() if n} == {s: n for s, n in taken.items() if n}


def test_empty_table_and_a_table_without_words(spark):
    assert op10_mixing(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    got = op10_mixing(spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
