"""The pipeline's stages against brute force on the smallest documents."""

import hashlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as P
from leakfree.llm.language import train
from leakfree.llm.secret_scan import redact
from leakfree.session import checkpoint_base, scratch, stored

from .test_near_copies import brute_near_copies


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], sf), "test"))
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_each_stage(spark, steps):
    docs, known, single, clean, mixed, tokens = map(rows_of, steps)
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:5])
    model = train(steps[0])
    want = {r["doc_id"] for r in docs if (p := model.predict(r["text"]))[0] != "und" and p[1] >= P.MIN_SCORE}
    assert {r["doc_id"] for r in known} == want and len(known) > 0.9 * len(docs)
    classes = brute_near_copies({r["doc_id"]: r["text"] for r in known})
    assert sorted(r["doc_id"] for r in single) == sorted(set(classes.values()))
    assert sorted((r["doc_id"], redact(r["text"])) for r in single) == sorted((r["doc_id"], r["text"]) for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    texts = {r["doc_id"]: r for r in clean}
    assert all(texts[r["doc_id"]] == r for r in mixed)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [(r["doc_id"], library.encode(r["text"], add_eos=True)) for r in mixed]
    assert sorted((k, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for k, i in ids) == sorted(
        (r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in tokens)


def test_stages_take_nulls_repeats_clashing_columns_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, fp int, size string, n int"
    rows = [(1, None, None, None, None, 1, 1, "a", 1), (None, "the thing", None, None, 9, 1, 1, "a", 1),
            (2, "the thing and more", "en", "s", 18, 1, 1, "a", 1), (2, "the thing and more", "en", "s", 18, 1, 1, "a", 1),
            (3, "token=abcdef the", "en", None, 0, 1, 1, "a", 1), (4, "", "en", "s", 0, 1, 1, "a", 1)]
    df = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, df, sf)
        assert got.columns == df.columns and got.count() > 0
        assert stage(spark, df.limit(0), sf).count() == 0
    ids = [r.doc_id for r in P.dedup_stage(spark, df, sf).collect()]
    assert sorted(ids, key=str) == sorted([1, None, 2, 3], key=str)
    assert {r.text: r.n_chars for r in P.secrets_stage(spark, df, sf).where("doc_id = 3").collect()} == {"[SECRET] the": 12}


def test_stages_leave_little_behind(spark, sf):
    """Every stage's tables are gone but for the one its result reads; the whole run leaves its last input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = Path(checkpoint_base(spark).removeprefix("file:"))

    def tables():
        return set(folder.glob("scratch-*"))

    for name, stage in P.STAGES:
        before = tables()
        stage(spark, docs, sf)
        assert len(tables() - before) <= 1, name
    before = tables()
    P.run(spark, sf).count()
    assert len(tables() - before) == 1
    with scratch(spark):
        P.run(spark, sf).count()
    assert len(tables() - before) == 1


def test_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["__key", "__n", "__found", "__was", "__copies", "__size", "dedup_key", "dedup_place", "language_found", "text_before",
             "mix_key", "mix_source", "mix_size", "mix_copies", "mix_copy", "row", "d", "key", "copies"]
    wide = docs.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    for _, stage in P.STAGES[:-1]:
        want = stage(spark, docs, sf)
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, want.collect()))


def test_long_texts(spark, sf):
    line = " ".join(f"the word {i} of it" for i in range(60_000))
    rows = [(1, line, "en", "s", len(line)), (2, line + " more", "en", "t", 1), (3, "das ist ein Text und " * 50_000, "de", "s", 1), (4, "x" * 2_000_000, None, "s", 1)]
    df = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, df, sf).columns == df.columns
    assert sorted(r.doc_id for r in P.dedup_stage(spark, df, sf).collect()) == [1, 3, 4]
    assert [r.text for r in P.secrets_stage(spark, df, sf).orderBy("doc_id").collect()] == [r[1] for r in rows]


def test_registered():
    assert entry.queries()["pipeline"] is P.run
    assert {f"op{n}_" for n in range(1, 14)} == {q[:q.index("_") + 1] for q in entry.queries() if q.startswith("op")}
