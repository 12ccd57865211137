"""Near copies against planted edits."""

import random

import corpus_pipeline
from leakfree.llm import near_copies as N
from leakfree.llm.simhash import fingerprint


def jaccard(a, b):
    x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def shingle_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near_copies(texts):
    """Every key's smallest key reachable over links of similarity 0.8 and more, by all pairs."""
    sets, root = {k: shingle_sets(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if (both >= 0.8 * (len(x) + len(y) - both)) if x or y else True:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in keys}


def planted(n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rnd.randrange(20000)}" for _ in range(rnd.randrange(100, 600))]
        rate = rnd.uniform(0.0, 0.06)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(w if rnd.random() > rate else f"e{rnd.randrange(10**9)}" for w in words))]
    return rows


def test_recall_and_precision_of_the_stage(spark, sf):
    rows = planted()
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, df, sf).collect()}
    texts = dict(rows)
    near = {k for k in texts if k % 2 and jaccard(texts[k - 1], texts[k]) >= 0.8}
    far_bits = [k for k in near if (fingerprint(texts[k].encode()) ^ fingerprint(texts[k - 1].encode())).bit_count() > 4]
    assert len(near) > 100 and len(far_bits) > 0.3 * len(near)
    assert all(k in kept for k in texts if k not in near)
    assert len(near & kept) <= 0.02 * len(near)


def test_given_documents_against_all_pairs(spark):
    """On the documents of sf0.01 the classes are those of all pairs, and so recall is 1 in every band of similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_near_copies({r.doc_id: r.text for r in docs.collect()})
    got = {r.key: r.component for r in N.near_copies(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_nulls_repeats_empty_tables_and_hot_groups(spark):
    rnd = random.Random(5)
    hot = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(hot) if i % 2 else " ".join(hot[:i % 7 + 1] + [f"x{i}"] + hot[i % 7 + 2:])) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (903, "one two"), (None, "one two"), (None, "alone here"), (905, "a b c d e f")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as d", "3 as key", "4 as component")
    got = sorted(((r.key, r.component) for r in N.near_copies(df).collect()), key=str)
    named = {k: t for k, t in rows if k is not None}
    want = brute_near_copies(named)
    assert got == sorted([(k, want[k]) for k, _ in rows if k is not None] + [(None, 903), (None, None)], key=str)
    assert N.near_copies(df.limit(0)).collect() == []


def test_hashes_restate_the_sets():
    rnd = random.Random(3)
    for _ in range(50):
        a = [rnd.choice("abcdef") for _ in range(60)]
        b = [w if rnd.random() > 0.05 else "z" for w in a]
        got = N.similarity(N.shingles(" ".join(a).encode()), N.shingles(" ".join(b).encode()))
        assert got == jaccard(" ".join(a), " ".join(b))
    assert len(N.shingles(None)) == len(N.shingles(b" \n")) == 0 and N.similarity(N.shingles(b""), N.shingles(None)) == 1.0


def test_no_pair_is_checked_twice(spark, monkeypatch):
    import random

    from leakfree.llm import near_copies as module

    rng, pairs = random.Random(3), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(150)] = f"w{rng.randrange(5000)}"
        texts.append(" ".join(words))
    stored = module.stored

    def spy(df, name="stage", partition=None):
        out = stored(df, name, partition)
        if name in ("candidates", "new"):  # what the rounds hold against each other
            pairs.append({(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in out.select("u", "v").collect()})
        return out

    monkeypatch.setattr(module, "stored", spy)
    module.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(pairs) > 1 and sum(map(len, pairs)) == len(set().union(*pairs))


def test_bands_of_few_components_have_all_of_them_meet(spark):
    """A band leads with texts of several components in one round, each of another one; a band of one component has no leader."""
    rows = [(1, d, d // 2) for d in range(6)] + [(2, d, d) for d in range(9)] + [(3, d, 7) for d in range(5)]
    got = [tuple(r) for r in N._leaders(spark.createDataFrame(rows, "b long, d long, c long"), 1).select("b", "v", "vc").collect()]
    assert {(b, vc) for b, _, vc in got if b == 1} == {(1, 0), (1, 1), (1, 2)} and all((b, v, vc) in rows for b, v, vc in got)
    assert sum(b == 2 for b, _, _ in got) == len({vc for b, _, vc in got if b == 2}) == N.LEADERS
    assert not any(b == 3 for b, _, _ in got)


def test_near_copies_that_share_crowded_bands_only(spark):
    """Two near copies among many texts of one long passage, whose common bands all hold many of those, need not meet a leader."""
    rnd = random.Random(11)

    def fresh(n):
        return [f"w{rnd.randrange(10**9)}" for _ in range(n)]

    def bands(words):
        return set(N.bands_of(N.minima_of(N.shingles(" ".join(words).encode()))))

    common = fresh(150)
    family = [common + fresh(42) for _ in range(400)]
    held = [bands(words) for words in family]
    twins = []
    while len(twins) < 3:
        own = fresh(44)
        one, two = common + own[:23] + own[23:], common + own[:23] + fresh(19)
        shared = bands(one) & bands(two)
        crowded = all(sum(b in h for h in held) >= 60 for b in shared)
        if 0 < len(shared) < 4 and crowded and (fingerprint(" ".join(one).encode(), 5) ^ fingerprint(" ".join(two).encode(), 5)).bit_count() > 4:
            twins.append((one, two))
    texts = [" ".join(words) for words in [*family, *[w for pair in twins for w in pair]]]
    want = brute_near_copies(dict(enumerate(texts)))
    assert all(want[401 + 2 * n] == 400 + 2 * n for n in range(3))
    got = N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    assert {r.key: r.component for r in got.collect()} == want


def test_bands_are_never_sent_to_the_driver(spark, monkeypatch):
    """A text has 20 bands, which the planner takes for one."""
    plans, keep = [], N.Scratch.keep

    def spy(self, df, name="kept"):
        if name == "bands":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(N.Scratch, "keep", spy)
    texts = [(n, " ".join(f"w{n // 2}x{i}" for i in range(40))) for n in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.key: r.component for r in N.near_copies(docs).collect()} == {n: n - n % 2 for n in range(20)}
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
