"""SimHash against brute force."""

import random

import numpy as np
import pytest
import xxhash

from leakfree.llm import simhash as S
from leakfree.llm.components import connected_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[find(i)] = min(k, best.get(find(i), k))
    return sorted(((k, format(fp, "016x"), best.get(find(i))) for i, ((k, _), fp) in enumerate(zip(rows, fps, strict=True))), key=str)


def sample_rows():
    rnd = random.Random(3)
    vocab = ["w%d" % i for i in range(60)] + ["Élan", "ÀB"]
    rows = [(1, None), (2, ""), (3, " \n\x0b"), (4, "one Two"), (4, "one Two"), (5, "ONE\x0ctwo"), (None, "one two"), (None, "zz top qq")]
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 40, 200, 900]))]
        for _ in range(rnd.choice([1, 2, 9])):
            copy = [w if rnd.random() > 0.01 else rnd.choice(vocab) for w in words]
            rows.append((100 * base + rnd.randrange(90) + 10, " ".join(copy)))
    return rows


def test_equals_brute_force(spark):
    rows = sample_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component", "3 as key", "4 as t")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.op8_simhash(df.repartition(5)).collect()), key=str)
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})


def test_empty_table(spark):
    assert S.op8_simhash(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_near_pair_shares_a_table():
    rnd = random.Random(1)
    for free in ((1 << 64) - 1, 0x0F0F_F00F_1234_5678, 0b111111):
        masks = S.covering_masks(free)
        bits = [i for i in range(64) if free >> i & 1]
        assert len(masks) == 31 and all(masks)
        for _ in range(500):
            x = sum(1 << b for b in rnd.sample(bits, 4))
            assert any(not x & m for m in masks)


@pytest.mark.parametrize("bucket", [16, 40, 4096])
def test_large_buckets_are_split_without_losing_links(spark, bucket):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 62))
    fps = {center}
    for _ in range(500):
        x = center
        for b in rng.choice(20, rng.integers(1, 9), replace=False):
            x ^= 1 << int(b) * 3
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = S.links(df, bucket=bucket)
    assert all((u ^ v).bit_count() <= 4 for u, v in edges.collect())
    got = {r.node: r.component for r in connected_components(edges).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    assert {x: got.get(x, x) for x in fps} == {x: find(x) for x in fps}
    with pytest.raises(ValueError):
        S.links(df, bucket=2)


def test_components_of_a_path_a_star_and_a_loop(spark):
    path = [(i, i + 1) for i in range(300, 400)]
    edges = path + [(5, i) for i in range(6, 200)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(300, 401)} == {300} and {got[i] for i in range(5, 200)} == {5} and 3 not in got


def test_tables_of_fingerprints_are_never_sent_to_the_driver(spark, monkeypatch):
    """A fingerprint has 31 tables, which the planner takes for as large as the fingerprint; only the planner's own size is small here."""
    plans, stored = [], S.stored

    def spy(df, name="stage", partition=None):
        if name == "buckets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name, partition)

    monkeypatch.setattr(S, "stored", spy)
    fps = stored(spark.range(300).selectExpr("id * 7919 as fp"), "distinct")
    assert S.links(fps).count() > 0
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
