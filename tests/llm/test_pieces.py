"""Backtracking encoder against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from leakfree.llm import pieces
from leakfree.llm.pieces import MergeEncoder, encode_decode, op9_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
ATOMS = [" ", "  ", "   ", "▁", "a", "the", "er", "\n", "\t", "é", "Ⅷ", "👍", "0", "12", "中", "文", "ing", "==", "--", "　",
         "\r", "</s>", "x" * 9, " " * 17, "\x00", "é", "tion", "Th", "ç", "### ", "&&&"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return MergeEncoder(f.read())


def test_random_texts(library, encoder):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices(ATOMS, k=rnd.randrange(30))) for _ in range(4000)]
    texts += [c * n + e for n in (1, 2, 3, 7, 16, 33, 300, 1500, 5000) for c in " ea-=0▁" for e in ("", "b", "\n")]
    texts += ["".join(rnd.choices("abcdetionghr", k=6000))]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t, add_eos=True), t
        assert encoder.decode(ids) == library.decode(ids), t
    assert encoder.decode([encoder.bytes[255], encoder.end]) == library.decode([encoder.bytes[255], encoder.end])


def test_query_on_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_sentencepiece(docs, PATH).collect()}
    assert got == want


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, 0), (None, "", 0), (2, "a b", 0), (2, "a b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").selectExpr("*", "1 as key", "2 as decoded")
    got = [(r.key, r.ids, r.decoded) for r in encode_decode(df, PATH).collect()]
    assert (1, [2], "") in got and (None, [2], "") in got and len(got) == 4
    assert sum(g[2] == "a b" for g in got) == 2
    assert encode_decode(df.limit(0), PATH).count() == 0


def test_tasks_of_a_worker_share_an_encoder_with_bounded_caches(library, monkeypatch):
    """A second task does not start anew; caches that are full and turned over change nothing."""
    with open(PATH, "rb") as f:
        model = f.read()
    shared = pieces.kept_encoder(model)
    assert pieces.kept_encoder(bytes(bytearray(model))) is shared
    monkeypatch.setattr(pieces, "_CACHE", 5)
    monkeypatch.setattr(pieces, "_PAIRS", 7)
    rnd = random.Random(5)
    for _ in range(2):
        for _ in range(300):
            t = " ".join("".join(rnd.choices("abcdetion", k=rnd.randrange(9))) for _ in range(12))
            assert shared.encode(t) == library.encode(t, add_eos=True)
            assert len(shared.cache) <= 5 and len(shared.older) <= 5 and len(shared.pairs) <= 7
    pieces.kept_encoder.cache_clear()
