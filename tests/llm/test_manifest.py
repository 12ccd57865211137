"""The Merkle manifest against a plain restatement."""

import hashlib
import random
import zlib

import pytest

from leakfree.llm import manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def brute(rows):
    """One result row per row, by whole trees in memory."""
    def climb(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, i in zip(proofs, at, strict=True):
                first = i - i % 3
                p.append((nodes[first:i], nodes[i + 1:first + 3]))
            nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
            at = [i // 3 for i in at]
        return nodes[0], proofs

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        found[g] = own, climb([leaf_of(r) for r in own])
    root, above = climb([found[g][1][0] for g in names]) if names else (None, [])
    out = []
    for g, up in zip(names, above, strict=True):
        own, (subroot, proofs) = found[g]
        for r, p in zip(own, proofs, strict=True):
            whole = p + up
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = (*r[:4], r[4].replace("\n", ""))
            x = leaf_of(now)
            for left, right in whole:
                x = H(*left, x, *right)
            siblings = H(*[s for left, right in whole for s in left + right])
            out.append((r[0], leaf_of(r), subroot, root, siblings, x, x == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n) for i, s, lang, n, t in rows], SCHEMA).selectExpr("*", "1 as place", "2 as block", "'x' as g", "3 as key")


def rows_of(seed=2):
    rnd = random.Random(seed)
    sizes = {"hot": 260, "b": 28, "c": 10, "é": 9, "z": 3, "": 2, None: 4, "one": 1}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rnd.choice([None, "", "a\nb", "lines\n\nof é text\n" * rnd.randint(1, 5), "plain"])
            rows.append((i, source, rnd.choice(["de", None]), None if text is None else len(text), text))
            i += 1
    rows += [(None, "b", None, None, None), (None, "hot", "en", 3, "x\ny")]
    rows += [rows[0], rows[0], (7, "hot", "fr", 1, "\n"), (5000, "long", None, 900_000, "word\n" * 180_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_equals_whole_trees(spark, depth, monkeypatch):
    monkeypatch.setattr(M.merkle_manifest, "__defaults__", (*M.merkle_manifest.__defaults__[:-1], depth))
    rows = rows_of()
    got = sorted((tuple(r) for r in M.op13_manifest(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_small_and_empty_tables(spark):
    assert M.op13_manifest(frame(spark, []).limit(0)).collect() == []
    one = [(3, None, None, None, None)]
    got = [tuple(r) for r in M.op13_manifest(frame(spark, one)).collect()]
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H()


def test_tampering_is_seen_and_nothing_else(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = M.op13_manifest(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    cut = {r[0] for r in rows if r[4] and "\n" in r[4] and zlib.crc32(str(r[0]).encode()) % 2 == 0}
    assert {r.doc_id for r in got if not r.verified} == cut and cut


def test_other_fields_and_fanout(spark):
    df = spark.range(50).selectExpr("id as k", "id % 3 as g", "cast(id as string) as v")
    out = M.merkle_manifest(df, ["k", "v"], "k", "g", fanout=2, depth=2)
    assert out.count() == 50 and out.where(M.folded(out.leaf, out.proof) != out.root).isEmpty()
    assert out.where("leaf <> found").isEmpty()
